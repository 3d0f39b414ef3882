"""Corpus-relative scores, families and tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hex_int
from .skew import kept, quantiles


@dataclass(frozen=True)
class Limits:
    """Fixed values of the tier rules."""

    uncertain: float = 1.2
    gaming: float = 0.35
    nsfw_route: float = 0.65
    nsfw_queue: float = 0.35
    identity_route: float = 0.10
    identity_queue: float = 0.20
    queue: float = 0.90
    review: float = 0.75
    margin: float = 0.05
    slack: float = 0.15
    audit: int = 20


def z(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 1e-12, (x - mean) / sd).otherwise(F.when(x.isNotNull(), F.lit(0.0)))


def zscores(rows: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """Population z-scores; a column without spread scores zero. The statistics are one row."""
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    return rows.crossJoin(F.broadcast(stats)).select(*rows.columns, *(z(F.col(c), F.col(f"mean_{c}"), F.col(f"sd_{c}")).alias(prefix + c) for c in columns))


def consensus(rows: DataFrame, signals: list[str], sigma: tuple[str, str] | None = None) -> DataFrame:
    """Adds consensus_z and disagreement; both null for all rows if any row lacks a signal.

    sigma: (column of a signal's own deviation, that signal); it adds (sigma / sd of the signal)^2 / signals.
    """
    needed = signals + ([sigma[0]] if sigma else [])
    stats = [F.coalesce(F.bool_and(F.greatest(*(F.col(c).isNull().cast("int") for c in [*needed, needed[0]])) == 0), F.lit(False)).alias("complete")]
    stats += [f(c).alias(f"{n}_{c}") for c in signals for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    rows = kept(rows)
    scored = rows.crossJoin(F.broadcast(rows.agg(*stats)))
    zs = F.array(*(z(F.col(c), F.col(f"mean_{c}"), F.col(f"sd_{c}")) for c in signals))
    k = len(signals)
    mean = F.aggregate("_z", F.lit(0.0), lambda a, x: a + x) / k
    spread = F.aggregate("_z", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / k
    native = F.lit(0.0)
    if sigma:
        native = F.when(F.col(f"sd_{sigma[1]}") > 1e-12, F.pow(F.col(sigma[0]) / F.col(f"sd_{sigma[1]}"), 2) / k).otherwise(0.0)
    scored = scored.withColumn("_z", zs).withColumn("_m", F.when(F.col("complete"), mean)).withColumn("disagreement", F.when(F.col("complete"), F.sqrt(spread + native)))
    scored = kept(scored)
    again = scored.agg(F.avg("_m").alias("_mm"), F.stddev_pop("_m").alias("_ms"))
    return scored.crossJoin(F.broadcast(again)).select(*rows.columns, "complete", z(F.col("_m"), F.col("_mm"), F.col("_ms")).alias("consensus_z"), "disagreement")


def family_id(members: Column, profile: str) -> Column:
    """Digest of the profile and the sorted distinct contents of a family."""
    return F.sha2(F.concat(F.lit(f'["{profile}",["'), F.array_join(F.array_sort(F.array_distinct(members)), '","'), F.lit('"]]')), 256)


def champions(rows: DataFrame) -> DataFrame:
    """Adds place (1: champion, 2: runner-up) and champion_z within family_id."""
    w = Window.partitionBy("family_id").orderBy(F.coalesce("consensus_z", F.lit(0.0)).desc(), "sha256", "position")
    best = F.first(F.coalesce("consensus_z", F.lit(0.0))).over(w)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("champion_z", best)


def tiers(rows: DataFrame, signals: list[str], limits: Limits = Limits(), sigma: tuple[str, str] | None = None) -> DataFrame:
    """Adds consensus_z, disagreement, place, flags and proposed_tier.

    rows: position, sha256, family_id, the signals, identity_sim, confusable_margin, nsfw_prob, gaming_delta.
    """
    needed = signals + ([sigma[0]] if sigma else [])
    scored = kept(champions(consensus(rows, signals, sigma)))
    told = scored.agg(F.coalesce(F.bool_and(F.col("identity_sim").isNotNull()), F.lit(False)).alias("ids_complete"))
    low = quantiles(scored, "identity_sim", {"q_ir": limits.identity_route, "q_iq": limits.identity_queue})
    high = quantiles(scored, "consensus_z", {"q_q": limits.queue, "q_r": limits.review})
    q = told.crossJoin(low).crossJoin(high)  # one row each
    d = scored.crossJoin(F.broadcast(q))
    ir, iq = (F.when(F.col("ids_complete"), F.col(c)) for c in ("q_ir", "q_iq"))
    col = F.col
    nsfw = F.coalesce(col("nsfw_prob") >= limits.nsfw_route, F.lit(False))
    low = F.coalesce((col("identity_sim") < ir) & (col("confusable_margin").isNull() | (col("confusable_margin") < limits.margin)), F.lit(False))
    flags = F.array_compact(F.array(
        *(F.when(col(c).isNull(), F.lit(f"signal_unavailable:{c}")) for c in [*needed, "identity_sim", "nsfw_prob"]),
        F.when(~col("complete"), "quality_population_unavailable"),
        F.when(~col("ids_complete"), "identity_population_unavailable"),
        F.when(col("disagreement") > limits.uncertain, "uncertain"),
        F.when(col("gaming_delta") > limits.gaming, "gaming_suspect"),
        F.when(nsfw, "nsfw"),
        F.when(col("complete") & (col("place") > 1), "near_dup_runnerup"),
    ))
    d = d.withColumns({"_nsfw": nsfw, "_low": low, "_flags": flags})
    bare = F.size("_flags") == 0
    queue = bare & (col("consensus_z") >= col("q_q")) & (col("nsfw_prob") < limits.nsfw_queue) & (col("identity_sim") >= iq) & ((col("place") == 1) | (col("champion_z") - col("consensus_z") <= limits.slack))
    archive = bare & (col("consensus_z") < col("q_r"))
    sampled = hex_int(col("sha256")) % limits.audit == 0
    tier = F.when(col("_nsfw"), "route_nsfw").when(col("_low"), "route_identity").when(queue, "queue").when(archive & ~sampled, "archive_candidate").otherwise("review")
    last = F.when(~col("_nsfw") & col("_low"), F.array(F.lit("id_low"))).when(~col("_nsfw") & ~F.coalesce(queue, F.lit(False)) & archive & sampled, F.array(F.lit("audit_sample"))).otherwise(F.array().cast("array<string>"))
    return d.select(*rows.columns, "consensus_z", "disagreement", "place", F.array_join(F.concat("_flags", last), "|").alias("flags"), tier.alias("proposed_tier"))
