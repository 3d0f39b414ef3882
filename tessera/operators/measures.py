"""Measures of folders and clusters with their denominators, what they admit, and support for aliases.

Counts are aggregated by (group, value) before anything is compared, so a folder or a cluster of any size is spread.
What isn't known is null: a share over a part that was observed says so by its denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import wilson
from .grouping import loo_coherence
from .skew import group_quantiles, kept


def modal(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, labelled, distinct, modal, most: the commonest value that isn't null, of equals the one that comes first by `order`."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.min_by(value, F.struct(-F.col("n"), F.col("first")))
    return n.groupBy(group).agg(F.sum("n").alias("labelled"), F.count("*").alias("distinct"), best.alias("modal"), F.max("n").alias("most"))


def admitted(valid: Column, median: Column, p10: Column, least: int = 30) -> Column:
    return F.coalesce((valid >= least) & (median >= 0.90) & (p10 >= 0.80), F.lit(False))


def folder_measures(images: DataFrame, labels: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """A row for each folder of sampled images.

    images: folder, image, v (unit or null), profile, representation, face_clusters (array with nulls, or null where
    faces weren't looked for), candidates (array or null), conflict (boolean or null); labels: image, identity, artist,
    entity of independent people; targets: folder, target, kind. Vectors of several profiles aren't compared.
    """
    d = kept(images.join(labels, "image", "left"))
    same = d.filter("v IS NOT NULL").groupBy("folder").agg((F.count_distinct("profile") == 1).alias("p"), (F.count_distinct("representation") == 1).alias("r"), F.count_if(F.col("profile").isNull()).alias("none"), F.max("representation").alias("representation"))
    same = same.select("folder", (F.col("p") & F.col("r") & (F.col("none") == 0)).alias("one_profile"), "representation")
    vectors = d.join(same, "folder", "left").select(F.col("folder").alias("g"), F.col("image").alias("k"), F.when(F.col("one_profile"), F.col("v")).alias("v"))
    stats = loo_coherence(vectors, width).select(F.col("g").alias("folder"), "valid", "median", "p10")
    t = targets.select("folder", "target", "kind")
    j = d.join(F.broadcast(t) if t.count() <= 100_000 else t, "folder", "left")
    has = lambda c: F.coalesce(F.array_contains("candidates", F.col(c)), F.lit(False))
    one = F.size("candidates") != 1
    whole = j.groupBy("folder").agg(
        F.count("*").alias("n"), F.count("candidates").alias("known"), F.count_if(F.size("candidates") == 0).alias("unknown"), F.count("conflict").alias("judged"), F.count_if(F.col("conflict")).alias("conflicts"),
        F.max("target").alias("target"), F.max("kind").alias("kind"), F.count_if(F.col("identity") == F.col("target")).alias("on_target"), F.count("identity").alias("identities"),
        F.count_if(F.col("candidates").isNotNull() & has("target")).alias("agree"), F.count_if(F.col("candidates").isNotNull() & (one | ~has("target"))).alias("open"),
        F.count("face_clusters").alias("looked"), F.sum(F.when(F.col("face_clusters").isNotNull(), F.size("face_clusters"))).alias("faces"), F.count_if(F.size("face_clusters") != 1).alias("odd"),
        F.count_distinct(F.when(F.col("artist").isNotNull(), F.col("entity"))).alias("entities"),
    )
    each = d.select("folder", "image", F.explode("face_clusters").alias("cluster")).filter("cluster IS NOT NULL")
    per = each.groupBy("folder", "cluster").agg(F.count("*").alias("faces"), F.count_distinct("image").alias("images")).groupBy("folder").agg(F.max("faces").alias("top"), F.count_if(F.col("images") >= 3).alias("supported"))
    who = modal(d, "folder", "identity", "image").withColumnsRenamed({"labelled": "id_labels", "distinct": "ids", "modal": "identity", "most": "id_most"})
    by = modal(d, "folder", "artist", "image").withColumnsRenamed({"labelled": "artist_labels", "distinct": "artists", "modal": "artist", "most": "artist_most"})
    r = whole.join(stats, "folder", "left").join(same, "folder", "left").join(per, "folder", "left").join(who, "folder", "left").join(by, "folder", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    applies = F.col("target").isNotNull() & F.col("kind").isin("character", "work") & (F.col("known") == F.col("n"))
    w = wilson(F.col("id_most"), F.col("n"), F.col("n") + 1)
    ok = admitted(F.col("valid"), F.col("median"), F.col("p10"))
    return r.select(
        "folder", "n", "valid", "median", "p10", ok.alias("coherent"), "identity", F.coalesce("id_labels", F.lit(0)).alias("id_labels"), share("id_most", "n").alias("purity"), w["low"].alias("purity_low"),
        F.when(F.col("target").isNotNull() & (F.col("identities") > 0), F.col("on_target") / F.col("n")).alias("target_purity"), share("artist_most", "n").alias("artist_share"), F.coalesce("artist_labels", F.lit(0)).alias("artist_labels"), "entities",
        share("unknown", "known").alias("unknown"), share("conflicts", "judged").alias("conflict"), F.when(applies, F.col("agree") / F.col("n")).alias("agreement"), F.when(applies, F.col("open") / F.col("n")).alias("unresolved"), (F.col("known") / F.col("n")).alias("coverage"),
        F.coalesce("faces", F.lit(0)).alias("faces"), F.when(F.col("representation") == "whole-image", F.col("median")).alias("V"), F.when(F.col("faces") > 0, F.coalesce("top", F.lit(0)) / F.col("faces")).alias("F"),
        F.when(F.col("looked") == F.col("n"), F.coalesce("supported", F.lit(0))).alias("K"), F.when(F.col("looked") == F.col("n"), F.col("odd") / F.col("n")).alias("Q"),
        F.coalesce(ok & (F.col("median") >= 0.90) & (F.col("id_labels") >= 30) & (w["low"] >= 0.90), F.lit(False)).alias("recommended"),
    )


def cluster_measures(faces: DataFrame, occurrences: DataFrame, width: int) -> DataFrame:
    """A row for each cluster: images, faces, share of outliers, coherence, reasons against it, source concentration.

    faces: cluster, face, image, outlier, v (unit or null); an image's vector is that of its first face. occurrences:
    image, folder of those that can be read; concentration is the largest share of the images that one folder holds.
    """
    d = kept(faces.filter("cluster IS NOT NULL"))
    images = kept(d.groupBy("cluster", "image").agg(F.min_by("v", "face").alias("v")))
    stats = loo_coherence(images.select(F.col("cluster").alias("g"), F.col("image").alias("k"), "v"), width).withColumnRenamed("g", "cluster").withColumnRenamed("denominator", "images")
    n = d.groupBy("cluster").agg(F.count("*").alias("faces"), F.avg(F.col("outlier").cast("double")).alias("outlier_share"))
    held = images.join(occurrences.select("image", "folder").distinct(), "image").groupBy("cluster", "folder").agg(F.count_distinct("image").alias("h")).groupBy("cluster").agg(F.max("h").alias("h"))
    j = stats.join(n, "cluster").join(held, "cluster", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("images") < 10, "fewer-than-10-distinct-images"), F.when(F.col("valid") != F.col("images"), "insufficient-or-invalid-same-profile-vectors"),
        F.when(F.coalesce(F.col("median") < 0.90, F.lit(True)), "median-below-0.90-or-unavailable"), F.when(F.coalesce(F.col("p10") < 0.80, F.lit(True)), "p10-below-0.80-or-unavailable"),
    ))
    return j.select("cluster", "images", "faces", "outlier_share", "valid", "median", "p10", F.array_join(reasons, "|").alias("reasons"), (F.size(reasons) == 0).alias("eligible"), (F.coalesce("h", F.lit(0)) / F.col("images")).alias("concentration"))


def recommendations(valid: DataFrame, covered: DataFrame, inherited: DataFrame, eligible: DataFrame) -> DataFrame:
    """One row: eligible clusters, valid and covered images, coverage by clusters and by folders, and what to show first.

    valid, covered, inherited: image; eligible: cluster.
    """
    v = valid.select("image").distinct().join(covered.select("image").distinct().withColumn("c", F.lit(1)), "image", "left").join(inherited.select("image").distinct().withColumn("i", F.lit(1)), "image", "left")
    one = v.agg(F.count("*").alias("valid_images"), F.count("c").alias("c"), F.count("i").alias("i"))
    n = eligible.agg(F.count_distinct("cluster").alias("eligible_clusters")).crossJoin(covered.agg(F.count_distinct("image").alias("covered_images")))
    share = lambda x: F.when(F.col("valid_images") > 0, F.col(x) / F.col("valid_images"))
    r = one.crossJoin(n).withColumns({"cluster_coverage": share("c"), "folder_coverage": share("i")})  # one row each
    first = (F.col("eligible_clusters") >= 3) & (F.col("valid_images") > 0) & (F.col("cluster_coverage") >= 0.20)
    return r.select("eligible_clusters", "covered_images", "valid_images", "cluster_coverage", "folder_coverage", F.coalesce(first, F.lit(False)).alias("clusters_first"), F.coalesce(F.col("folder_coverage") >= 0.50, F.lit(False)).alias("inheritance"))


def _support(rows: DataFrame, p: str) -> DataFrame:
    """name, tag and the spread of the best score of each image, with the images where the tag comes first."""
    best = kept(rows.groupBy("name", "tag", "image").agg(F.max("score").alias("score"), F.bool_or("top").alias("top")))
    n = best.groupBy("name", "tag").agg(F.count("*").alias(f"{p}_images"), F.count_if("top").alias(f"{p}_top"), F.min("score").alias(f"{p}_min"), F.max("score").alias(f"{p}_max"))
    q = group_quantiles(best, ["name", "tag"], "score", {f"{p}_p25": 0.25, f"{p}_median": 0.5, f"{p}_p75": 0.75})
    return n.join(q, ["name", "tag"])


def alias_bank(observations: DataFrame, references: DataFrame, cohorts: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each (reference name, tag): direct support by the reference's own images, support by the images that are
    nearest to it, strength, decision and rank.

    observations: image, tag, score, top; references and cohorts: name, image; known: name, tag, decision. A tag is
    relatively strong if at least 3 direct images, 0.8 of the tagged ones, have it with a median of 0.85 or more.
    """
    direct = kept(observations.join(references.select("name", "image").distinct(), "image"))
    tagged = direct.groupBy("name").agg(F.count_distinct("image").alias("tagged"))
    near = observations.join(cohorts.select("name", "image").distinct(), "image")
    j = _support(direct, "d").join(_support(near, "c"), ["name", "tag"], "full").join(tagged, "name", "left").join(known, ["name", "tag"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    strong = (count("d_images") >= 3) & (count("d_images") / F.greatest(count("tagged"), F.lit(1)) >= 0.8) & (F.coalesce("d_median", F.lit(0.0)) >= 0.85)
    order = Window.partitionBy("name").orderBy(count("d_images").desc(), count("c_images").desc(), F.coalesce("d_median", "c_median", F.lit(0.0)).desc(), "tag")
    return j.select(
        "name", "tag", F.row_number().over(order).alias("rank"), count("d_images").alias("direct_images"), count("d_top").alias("direct_top"), "d_min", "d_p25", "d_median", "d_p75", "d_max", count("c_images").alias("cohort_images"), "c_median",
        F.when(strong, "relatively-strong").otherwise("weak").alias("strength"), F.coalesce("decision", F.lit("unconfirmed")).alias("decision"),
    )


def loo_image_scores(faces: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """image, score of every image with an available face: the best cosine of a face to a target group's sum without the face itself.

    faces: face, image, g (null: in no group), v; targets: g. Groups that sum to nothing without the face are unavailable.
    """
    from ..functions.scalars import clip, dot
    from .grouping import summed

    total = faces.join(targets.select("g").distinct(), "g").groupBy("g").agg(summed(F.col("v"), width).alias("t"))
    j = faces.crossJoin(F.broadcast(total.withColumnRenamed("g", "tg")))  # a row for each target group, few by definition
    own = F.zip_with("t", "v", lambda a, b: a - F.when(F.col("g") == F.col("tg"), b.cast("double")).otherwise(0.0))
    s = j.withColumn("o", own).withColumn("len", F.sqrt(dot(F.col("o"), F.col("o")))).filter(F.col("len") > 1e-12)
    return s.groupBy("image").agg(F.max(clip(dot(F.col("v"), F.col("o")) / F.col("len"))).alias("score"))


def image_strata(subjects: DataFrame) -> DataFrame:
    """image, stratum: auto if all subjects are, none if all that may be decided are, else review. subjects: image, tier, eligible."""
    g = subjects.groupBy("image").agg(F.bool_and(F.col("tier") == "auto").alias("auto"), F.bool_and(F.when(F.col("eligible"), F.col("tier") == "none")).alias("none"))
    return g.select("image", F.when(F.col("auto"), "auto").when(F.col("none"), "none").otherwise("review").alias("stratum"))


def representatives(rows: DataFrame, group: str, content: str, most: int = 24) -> DataFrame:
    """group, occurrences and the first `most` distinct contents by hash."""
    n = rows.groupBy(group).agg(F.count("*").alias("occurrences"))
    w = Window.partitionBy(group).orderBy(content)
    first = rows.select(group, content).distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return n.join(first.groupBy(group).agg(F.array_sort(F.collect_list(content)).alias("first")), group, "left")


def spread(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n and the quantiles 0, .25, .5, .75, .95 and 1 of a value."""
    d = kept(rows.filter(F.col(value).isNotNull()).select(group, value))
    return d.groupBy(group).agg(F.count("*").alias("n")).join(group_quantiles(d, [group], value, {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q100": 1.0}), group)


def admission(files: DataFrame, reservation: int, quota: int, free: int, reserve: int) -> DataFrame:
    """One row: bytes that are retained, whether the quota and the free disk admit a reservation, and the reason if not."""
    kept_bytes = F.coalesce(F.sum("size"), F.lit(0))
    over = kept_bytes + F.lit(reservation) > F.lit(quota)
    low = F.lit(free) < F.lit(reservation) + F.lit(reserve)
    return files.agg(kept_bytes.alias("retained"), F.when(over, "derived-quota-exceeded").when(low, "free-disk-reserve-violated").otherwise("admitted").alias("status"))
