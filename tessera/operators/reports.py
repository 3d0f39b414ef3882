"""Reports about labels and scores: agreement of two score sets, groups by label, abstentions, reuse, columnar payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from .skew import kept, quantiles as exact


def pass_agreement(rows: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.2, 0.9)) -> DataFrame:
    """quantile, threshold, paired, agreement, disagreement, gained, lost of rows with old and new scores.

    The threshold is a quantile of all old scores; only rows that have both scores are paired.
    """
    limits = exact(rows, "old", {f"t{i}": q for i, q in enumerate(quantiles)})
    d = rows.crossJoin(F.broadcast(limits)).filter("old IS NOT NULL AND new IS NOT NULL")  # one row
    each = d.select("old", "new", F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(f"t{i}").alias("threshold")) for i, q in enumerate(quantiles)))).alias("q"))
    a, b = F.col("old") >= F.col("q.threshold"), F.col("new") >= F.col("q.threshold")
    return each.groupBy("q.quantile", "q.threshold").agg(F.count("*").alias("paired"), F.count_if(a == b).alias("agreement"), F.count_if(a != b).alias("disagreement"), F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost"))


def label_groups(labels: DataFrame, faces: DataFrame) -> DataFrame:
    """label, images, faces, mean_sim, min_margin of every label, those without a face too. faces: image, label, sim, margin."""
    g = faces.groupBy("label").agg(F.count_distinct("image").alias("images"), F.count("*").alias("faces"), F.avg("sim").alias("mean_sim"), F.min("margin").alias("min_margin"))
    return labels.select("label").distinct().join(g, "label", "left").select("label", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("faces", F.lit(0)).alias("faces"), "mean_sim", "min_margin")


def abstained(faces: DataFrame) -> DataFrame:
    """cluster (null is a group), faces, images of faces without a label."""
    return faces.filter("label IS NULL").groupBy("cluster").agg(F.count("*").alias("faces"), F.count_distinct("image").alias("images"))


def image_counts(images: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: images, zero_face, unassigned, any_abstained, multi_label."""
    g = faces.groupBy("image").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.count_if(F.col("label").isNull()).alias("none"))
    j = images.select("image").distinct().join(g, "image", "left")
    return j.agg(F.count("*").alias("images"), F.count_if(F.col("n").isNull()).alias("zero_face"), F.count_if(F.coalesce("labels", F.lit(0)) == 0).alias("unassigned"), F.count_if(F.col("none") > 0).alias("any_abstained"), F.count_if(F.col("labels") > 1).alias("multi_label"))


def pinned(members: DataFrame) -> DataFrame:
    """cluster, name: the name on which all named members agree, else null. members: cluster, name (null: unnamed)."""
    return members.groupBy("cluster").agg(F.when(F.min("name") == F.max("name"), F.min("name")).alias("name"))


def role(name: Column, cluster: Column) -> Column:
    """What an unnamed face is called in exports."""
    # fixed values
    return F.coalesce(name, F.when(cluster.isNotNull(), F.concat(F.lit("新人物"), F.when(F.length(cluster.cast("string")) < 2, F.lpad(cluster.cast("string"), 2, "0")).otherwise(cluster.cast("string")))), F.lit("未知人物"))


def reused(wanted: DataFrame, entries: DataFrame, provider: str) -> DataFrame:
    """key, evidence of every wanted key that has an unambiguous compatible entry, the provider's own preferred.

    wanted: key; entries: key, provider, compatible, evidence.
    """
    e = entries.filter("compatible").withColumn("own", F.col("provider") == provider)
    g = e.groupBy("key").agg(F.max("own").alias("any"), *(f("evidence").alias(n) for n, f in (("lo", F.min), ("hi", F.max))), *(f(F.when(F.col("own"), F.col("evidence"))).alias(n) for n, f in (("own_lo", F.min), ("own_hi", F.max))))
    got = g.select("key", F.when(F.col("any"), F.when(F.col("own_lo") == F.col("own_hi"), F.col("own_lo"))).otherwise(F.when(F.col("lo") == F.col("hi"), F.col("lo"))).alias("evidence"))
    return wanted.select("key").distinct().join(got, "key").filter("evidence IS NOT NULL")


def vector_agreement(pairs: DataFrame, absolute: float = 1e-3, relative: float = 1e-3, cosine: float = 1e-5) -> DataFrame:
    """One row that holds unit vectors x against y: largest and median deviations, and whether they stay in their budgets."""
    error = F.zip_with("x", "y", lambda a, b: F.abs(a - b))
    d = pairs.select((1 - dot(F.col("x"), F.col("y"))).alias("c"), F.array_max(error).alias("e"), F.forall(F.zip_with("x", "y", lambda a, b: F.abs(a - b) <= absolute + relative * F.abs(a)), lambda ok: ok).alias("ok"))
    d = kept(d)
    one = d.agg(F.max("c").alias("max_cosine"), F.max("e").alias("max_component"), F.bool_and("ok").alias("component_pass"), (F.max("c") <= cosine).alias("cosine_pass"))
    return one.crossJoin(exact(d, "c", {"median_cosine": 0.5}))  # one row each


def columnar_payload(rows: DataFrame, position: str, columns: list[str], coded: dict[str, list[str]], chunk: int = 10_000) -> DataFrame:
    """chunk, rows, payload, sha256: JSON of one array for each column, by position; coded columns hold indexes of their lists.

    A chunk has at most `chunk` positions, so a payload stays small however long the table is.
    """
    code = lambda c, xs: F.array_position(F.array(*(F.lit(x) for x in xs)), F.col(c)) - 1
    d = rows.select(F.floor(F.col(position) / chunk).alias("chunk"), F.struct(F.col(position).alias("_p"), *(F.col(c) if c not in coded else code(c, coded[c]).alias(c) for c in columns)).alias("r"))
    g = d.groupBy("chunk").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list("r")).alias("all"))
    out = g.select("chunk", "rows", F.to_json(F.struct(*(F.col("all").getField(c).alias(c) for c in columns)), {"ignoreNullFields": "false"}).alias("payload"))
    return out.withColumn("sha256", F.sha2("payload", 256))
