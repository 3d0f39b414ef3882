"""Ordered decision policies: regimes, model proposals, first pass, audits, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import placed_within

#: Fixed gates of each regime: feature, comparison, boundary.
REGIMES = {
    "session-set": (("valid_images", ">=", 30), ("v", ">=", 0.90), ("f", ">=", 0.80), ("eligible_faces", ">=", 30)),
    "mixed-pile": (("valid_images", ">=", 30), ("v", "<", 0.80), ("f", "<", 0.50), ("k", ">=", 3)),
    "scenario/documentary": (("valid_images", ">=", 30), ("v", ">=", 0.85), ("q", ">=", 0.50), ("f", "<", 0.80)),
    "artist-portfolio": (("valid_images", ">=", 30), ("a", ">=", 0.80), ("artist_labels", ">=", 30), ("entities", ">=", 3)),
}


def regimes(rows: DataFrame) -> DataFrame:
    """Adds each detector's status, passing and status: missing evidence is unavailable, never a failure."""

    def status(gates: tuple) -> Column:
        held = [F.col(f) >= b if op == ">=" else F.col(f) < b for f, op, b in gates]
        unknown, passed = held[0].isNull(), held[0]
        for g in held[1:]:
            unknown, passed = unknown | g.isNull(), passed & g
        return F.when(unknown, "unavailable").when(passed, "pass").otherwise("fail")

    names = {n: f"s{i}" for i, n in enumerate(REGIMES)}
    d = rows.withColumns({names[n]: status(g) for n, g in REGIMES.items()})
    passing = F.array_compact(F.array(*(F.when(F.col(c) == "pass", F.lit(n)) for n, c in names.items())))
    none = F.forall(F.array(*names.values()), lambda s: s == "unavailable")
    verdict = F.when(F.size(passing) > 1, "ambiguous").when(F.size(passing) == 1, "recommended").when((F.col("valid_images") < 30) | none, "insufficient-evidence").otherwise("undetermined")
    return d.select(*rows.columns, *names.values(), F.array_join(passing, "|").alias("passing"), verdict.alias("status"))


def propose(candidates: DataFrame, score: float = 0.85, margin: float = 0.20, floor: float = 0.35) -> DataFrame:
    """k, name, score, margin of the best candidate if it is high and leads enough; a missing runner-up counts as the floor."""
    w = Window.partitionBy("k").orderBy(F.col("score").desc(), "name")
    d = candidates.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("rn = 1")
    d = d.withColumn("margin", F.round(F.col("score") - F.coalesce("next", F.lit(floor)), 12))
    return d.filter((F.col("score") >= score) & (F.col("margin") >= margin)).select("k", "name", "score", "margin")


def top_candidates(candidates: DataFrame, n: int, above: float = 0.35) -> DataFrame:
    """k, name, score, rank of the n best candidates over the floor."""
    w = Window.partitionBy("k").orderBy(F.col("score").desc(), "name")
    return candidates.filter(F.col("score") > above).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_pass(rows: DataFrame, min_sim: float = 0.90, min_margin: float = 0.05, human_first: bool = False) -> DataFrame:
    """k, tier, reasons. rows: k, rivals, margin, supported, calibrated, sim, conflicts, model_score, model_next, model_agrees."""
    c = F.col
    conflicted = F.filter(c("conflicts"), lambda x: x.isNotNull())
    winner = c("sim").isNotNull()
    gates = [((c("rivals") >= 2), "insufficient-competing-identities"), ((c("margin") > 0), "ambiguous-or-disagreeing-winners"), (c("supported"), "human-support-required"), (c("calibrated"), "calibration-required"), ((c("sim") >= min_sim), "similarity-below-policy"), ((c("margin") >= min_margin), "margin-below-policy")]
    failed = F.array_compact(F.array(*(F.when(winner & ~F.coalesce(g, F.lit(False)), F.lit(r)) for g, r in gates), *([F.when(winner, F.lit("human-first"))] if human_first else [])))
    demoted = F.array_compact(F.array(F.when(c("model_score").isNotNull() & ~c("model_agrees"), F.lit("model_demoted"))))
    first = F.concat(conflicted, demoted, failed)
    lead = c("model_score") - F.coalesce(c("model_next"), F.lit(0.35))
    model = F.array_compact(F.array(F.when(c("model_score") > 0.35, F.when((c("model_score") >= 0.85) & (lead >= 0.20), "model-only-hypothesis").otherwise("enumerated-model-candidate"))))
    auto = winner & (F.size(first) == 0)
    reasons = F.when(auto, F.array(F.lit("reference-gates-passed"))).otherwise(F.concat(first, model))
    some = winner | (F.size(reasons) > 0)
    return rows.select("k", F.when(auto, "auto").when(some, "review").otherwise("none").alias("tier"), F.array_join(F.when(some, reasons).otherwise(F.array(F.lit("no-actionable-evidence"))), "|").alias("reasons"))


def audit(rows: DataFrame, snapshot: str, seed: str = "audit-v1") -> DataFrame:
    """The ceil(5 %) rows of each tier with the smallest digest of seed, snapshot, tier and key."""
    digest = F.sha2(F.concat_ws("\n", F.lit(seed), F.lit(snapshot), "tier", F.col("k").cast("string")), 256)
    d = placed_within(rows.select("tier", "k", digest.alias("digest")), ["tier"], "digest", "k")
    return d.filter(F.col("place") < F.floor((F.col("n") + 19) / 20)).select("tier", "k", "digest")


def roll_up(states: DataFrame) -> DataFrame:
    """k, disposition: by priority pending, deferred, hypothesis, unknown; a single value stands; mixed values are hypotheses."""
    order = ["pending", "deferred", "hypothesis", "unknown-foreign"]
    rank = F.coalesce(*(F.when(F.col("state") == s, F.lit(i)) for i, s in enumerate(order)), F.lit(len(order)))
    g = states.groupBy("k").agg(F.min_by("state", rank).alias("first"), F.min(rank).alias("r"), F.count_distinct("state").alias("kinds"))
    return g.select("k", F.when(F.col("r") < len(order), F.col("first")).when(F.col("kinds") == 1, F.col("first")).otherwise("hypothesis").alias("disposition"))
