"""What the review page computes: payloads back to rows, orders, precedence, drafts and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decoded_payload(payloads: DataFrame, columns: dict[str, str], coded: dict[str, list[str]]) -> DataFrame:
    """The rows of columnar payloads (chunk, payload) again; coded columns become their lists' entries, and an index beyond the list fails."""
    kinds = ", ".join(f"`{c}` array<{'int' if c in coded else t}>" for c, t in columns.items())
    d = payloads.select(F.from_json("payload", kinds, {"mode": "FAILFAST"}).alias("p"))
    each = d.select(F.explode(F.arrays_zip(*(F.col(f"p.{c}").alias(c) for c in columns))).alias("r"))

    def value(c: str) -> Column:
        if c not in coded:
            return F.col(f"r.{c}")
        at = F.col(f"r.{c}")
        return F.when(at.between(0, len(coded[c]) - 1), F.element_at(F.array(*(F.lit(x) for x in coded[c])), at + 1)).when(at.isNotNull(), F.raise_error(F.concat(F.lit(f"{c}: no code "), at.cast("string"))).cast("string"))

    return each.select(*(value(c).alias(c) for c in columns))


def face_order(faces: DataFrame, uncertain_first: bool = False) -> DataFrame:
    """cluster, face, place: representatives in their order first, then the rest by face, or by falling uncertainty.

    faces: cluster, face, shown (place among the representatives, or null), uncertainty.
    """
    rest = [F.desc_nulls_last("uncertainty")] if uncertain_first else []
    first = [] if uncertain_first else [F.col("shown").asc_nulls_last()]
    w = Window.partitionBy("cluster").orderBy(*first, *rest, "face")
    return faces.select("cluster", "face", F.row_number().over(w).alias("place"))


def effective_labels(faces: DataFrame, journal: DataFrame, by_face: DataFrame, by_cluster: DataFrame, confirmed: DataFrame) -> DataFrame:
    """face, label, source: the journal's label, else the catalogue's by face, by cluster, else the confirmed character.

    faces: face, cluster; journal and by_face: face, label; by_cluster and confirmed: cluster, label.
    """
    j = faces
    for name, df, key in (("journal", journal, "face"), ("face", by_face, "face"), ("cluster", by_cluster, "cluster"), ("confirmed", confirmed, "cluster")):
        j = j.join(df.select(key, F.col("label").alias(f"_{name}")), key, "left")
    names = ("journal", "face", "cluster", "confirmed")
    return j.select("face", F.coalesce(*(F.col(f"_{n}") for n in names)).alias("label"), F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in names), F.lit("none")).alias("source"))


def sections(candidates: DataFrame, sources: tuple[str, ...] = ("model", "memory", "bucket")) -> DataFrame:
    """face and a column of ranked names for each source; sources that aren't named are in none. candidates: face, source, rank, name."""
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct("rank", "name")))), lambda x: x["name"]).alias(s)
    return candidates.groupBy("face").agg(*(of(s) for s in sources))


def draft_faults(drafts: DataFrame, members: DataFrame, least: int = 10) -> DataFrame:
    """draft, fault (empty if it may be sent), conflict: whether its members carry two or more assigned labels.

    drafts: draft, action (split or merge), part, cluster, member (null: the whole cluster); members: cluster, member,
    image, label. A split names disjoint proper parts of one cluster; a merge names clusters without a common member; both
    need `least` distinct images.
    """
    named = drafts.filter("member IS NOT NULL").select("draft", "action", "part", "cluster", "member")
    chosen = named.join(members.select("cluster", "member", "image", "label"), ["cluster", "member"], "left")
    whole = drafts.filter("member IS NULL").select("draft", "action", "part", "cluster").join(members, "cluster").select("cluster", "member", "draft", "action", "part", "image", "label")
    j = chosen.unionByName(whole)
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    of = j.join(size, "cluster", "left").groupBy("draft").agg(
        F.max("action").alias("action"), F.count_distinct("cluster").alias("clusters"), F.count("*").alias("n"), F.count_distinct("member").alias("different"), F.count_if(F.col("image").isNull()).alias("unknown"),
        F.count_distinct("image").alias("images"), F.max("size").alias("size"), F.count_distinct("label").alias("labels"),
    )
    split, c = F.col("action") == "split", F.col
    fault = (
        F.when(c("unknown") > 0, "unknown-member").when(c("n") != c("different"), "overlap").when(split & (c("clusters") != 1), "one-cluster-required").when(split & (c("different") >= c("size")), "proper-parts-required")
        .when(~split & (c("clusters") < 2), "two-clusters-required").when(c("images") < least, "too-few-images").otherwise("")
    )
    return of.select("draft", fault.alias("fault"), (c("labels") >= 2).alias("conflict"))


def restored_drafts(drafts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The saved drafts (name, tag, base, draft) whose pair is still there with the decision that they were made on. pairs: name, tag, decision."""
    j = drafts.join(pairs, ["name", "tag"])
    return j.filter(F.col("decision").eqNullSafe(F.col("base"))).select(*drafts.columns)


def exported_decisions(scopes: DataFrame, members: DataFrame, report: str) -> DataFrame:
    """scope, folder, images, members_digest, report: a row for each folder of a scope, bound to its members and to the report.

    scopes: scope, folder; members: folder, image. The digest is of the sorted distinct images, a line each.
    """
    g = members.groupBy("folder").agg(F.count_distinct("image").alias("images"), F.sha2(F.array_join(F.array_sort(F.collect_set("image")), "\n"), 256).alias("members_digest"))
    return scopes.join(g, "folder", "left").select("scope", "folder", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("members_digest", F.sha2(F.lit(""), 256)).alias("members_digest"), F.lit(report).alias("report"))


def suggestion_tier(verified: Column, model: Column, demoted: Column, space: Column) -> Column:
    """verified, else model unless it was demoted, with a variant where the name's space isn't resolved, else none."""
    shown = F.coalesce(demoted, F.lit(False))
    return F.when(verified.isNotNull(), "verified").when(model.isNotNull() & ~shown & space.isNull(), "model-unresolved").when(model.isNotNull() & ~shown, "model").otherwise("none")
