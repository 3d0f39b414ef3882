"""Queries of folder, cluster and alias measures, receipts and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import unit
from ..operators import measures
from ..operators.skew import kept
from ..sources.tables import table
from .matching import _EVIDENCE, _V, WIDTH, _vectors
from .scoring import SIGNALS, TIERED_SQL, _tiered


def _r(df, *cols: str):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _images(spark, d):
    k = F.col("vec_id")
    e = table(spark, d, "embeddings")
    near = F.transform("embedding", lambda x: x.cast("double"))
    faces = F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.when((k + i) % 7 != 0, (k + i) % 5))
    names = F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.concat(F.lit("n"), (F.col("label") + i).cast("string")))
    return e.select(
        F.col("label").alias("folder"), k.alias("image"), F.when(k % 50 != 0, unit(F.concat(F.array(F.lit(6.0) * (F.col("label") % 3)), F.slice(near, 2, WIDTH - 1)))).alias("v"),
        F.when((F.col("label") == 9) & (k % 2 == 0), "p2").otherwise("p1").alias("profile"), F.when(F.col("label") == 8, "crop").otherwise("whole-image").alias("representation"),
        F.when((F.col("label") < 5) | (k % 40 != 0), F.when(k % 4 == 3, F.array().cast("array<bigint>")).otherwise(faces)).alias("face_clusters"),
        F.when((F.col("label") % 2 == 0) | (k % 11 != 0), F.when(k % 3 == 2, F.array().cast("array<string>")).otherwise(names)).alias("candidates"), F.when(k % 13 != 0, k % 17 == 0).alias("conflict"),
    )


def _labels(spark, d):
    k = F.col("vec_id")
    say = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return table(spark, d, "embeddings").filter(k % 5 < 4).select(k.alias("image"), F.when(k % 9 != 0, say("n", F.when(k % 3 == 0, k % 4).otherwise(F.col("label")))).alias("identity"), F.when(k % 3 != 0, say("a", k % 2)).alias("artist"), say("e", k % 6).alias("entity"))


def _folders(spark, d):
    targets = table(spark, d, "embeddings").select(F.col("label").alias("folder")).distinct().filter("folder < 7").select("folder", F.concat(F.lit("n"), F.col("folder").cast("string")).alias("target"), F.when(F.col("folder") % 3 == 2, "place").otherwise("character").alias("kind"))
    return measures.folder_measures(_images(spark, d), _labels(spark, d), targets, WIDTH)


def folder_measures(spark, d):
    return _r(_folders(spark, d), "median", "p10", "purity", "purity_low", "target_purity", "artist_share", "unknown", "conflict", "agreement", "unresolved", "coverage", "V", "F", "Q")


def _clusters(spark, d):
    faces = _images(spark, d).select(F.when(F.col("image") % 16 != 0, F.col("folder")).alias("cluster"), F.col("image").alias("face"), F.floor(F.col("image") / 2).alias("image"), (F.col("image") % 19 == 0).alias("outlier"), "v")
    at = faces.select("image").distinct()
    held = at.select("image", F.concat(F.lit("s"), (F.col("image") % 3).cast("string")).alias("folder")).union(at.filter("image % 4 = 0").select("image", F.lit("s0")))
    return faces, measures.cluster_measures(faces, held.filter("image % 23 <> 0"), WIDTH)


def cluster_measures(spark, d):
    return _r(_clusters(spark, d)[1], "outlier_share", "median", "p10", "concentration")


def global_recommendations(spark, d):
    faces, c = _clusters(spark, d)
    c = kept(c)
    good = c.filter("images >= 10 AND outlier_share < 0.06").select("cluster")
    valid = _images(spark, d).filter("v IS NOT NULL").select(F.floor(F.col("image") / 2).alias("image"))
    folders = _folders(spark, d).filter("purity >= 0.4").select("folder")
    inherited = _images(spark, d).join(folders, "folder").select(F.floor(F.col("image") / 2).alias("image"))
    r = measures.recommendations(valid, faces.join(good, "cluster").select("image"), inherited, good)
    return _r(r, "cluster_coverage", "folder_coverage")


def alias_bank(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image"), F.concat(F.lit("t"), (F.col("l_partkey") % 12).cast("string")).alias("tag")).agg(F.round(F.max(F.col("l_quantity") / 50), 4).alias("score"))
    best = li.groupBy("image").agg(F.max(F.struct("score", "tag")).alias("b"))
    o = li.join(best, "image").select("image", "tag", "score", (F.col("tag") == F.col("b.tag")).alias("top"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    refs = s.filter("s_suppkey % 3 <> 0").select(F.col("n_name").alias("name"), F.col("s_suppkey").alias("image"))
    near = s.filter("s_suppkey % 2 = 0").select(F.concat("n_name", F.when(F.col("s_suppkey") % 5 == 0, "-x").otherwise("")).alias("name"), F.col("s_suppkey").alias("image"))
    known = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("t"), (F.col("n_nationkey") % 12).cast("string")).alias("tag"), F.when(F.col("n_nationkey") % 2 == 0, "confirmed").otherwise("rejected").alias("decision"))
    return _r(measures.alias_bank(o, refs, near, known), "d_p25", "d_median", "d_p75", "c_median")


def loo_image_scores(spark, d):
    v = _vectors(spark, d).select(F.col("k").alias("face"), F.floor(F.col("k") / 3).alias("image"), F.when(F.col("k") % 5 != 0, F.col("label")).alias("g"), "v")
    return _r(measures.loo_image_scores(v, spark.createDataFrame([(0,), (3,)], "g int"), WIDTH), "score")


def image_strata(spark, d):
    li = table(spark, d, "lineitem")
    tier = F.when(F.col("l_linestatus") == "F", "auto").when(F.col("l_returnflag") == "N", "none").otherwise("review")
    return measures.image_strata(li.select(F.col("l_orderkey").alias("image"), tier.alias("tier"), (F.col("l_linenumber") != 2).alias("eligible"))).groupBy("stratum").agg(F.count("*").alias("images"), F.min("image").alias("first"))


def folder_representatives(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("folder"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    r = measures.representatives(docs, "folder", "sha")
    return r.select("folder", "occurrences", F.array_join("first", "|").alias("first"))


def candidate_receipt(spark, d):
    """Coverage, demotions by source, and how candidates' scores are spread, by source."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.round(F.col("l_quantity") / 50, 4).alias("score"), "l_orderkey", (F.col("l_discount") > 0.07).alias("demoted"))
    n = li.groupBy("source").agg(F.count_distinct("l_orderkey").alias("covered"), F.count_if("demoted").alias("demoted"))
    return n.join(_r(measures.spread(li, "source", "score"), "q0", "q25", "q50", "q75", "q95", "q100"), "source")


def top_tags(spark, d):
    """The 20 commonest tags."""
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 70).alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


def corpus_summary(spark, d):
    """Distinct contents and families, bytes, rows with all signals, the share in review; and a histogram of sizes."""
    docs = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "source", "n_chars", "lang")
    r = docs.agg(F.count("*").alias("n"), F.count_distinct("sha").alias("contents"), F.count_distinct("source").alias("families"), F.sum("n_chars").alias("bytes"), F.count("lang").alias("complete"))
    whole = r.select(F.lit("whole").alias("kind"), F.lit("").alias("name"), "n", "contents", "families", "bytes", "complete")
    size = F.concat((F.floor(F.col("n_chars") / 1000) * 1000).cast("string"), F.lit("+"))
    by = docs.groupBy(size.alias("name")).agg(F.count("*").alias("n"), F.count_distinct("sha").alias("contents"), F.count_distinct("source").alias("families"), F.sum("n_chars").alias("bytes"), F.count("lang").alias("complete"))
    return whole.union(by.select(F.lit("size").alias("kind"), "name", "n", "contents", "families", "bytes", "complete"))


def duplicate_receipt(spark, d):
    """Contents of more than one path, and how many paths they have, by number of paths."""
    docs = table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.count("*").alias("paths"), F.count_distinct("lang").alias("kinds"))
    return docs.filter("paths > 1").groupBy("paths").agg(F.count("*").alias("contents"), F.max("kinds").alias("kinds"))


def cluster_sizes(spark, d):
    """How many clusters are how large, with the share of outliers and the images without a score."""
    k = F.col("c_custkey")
    f = table(spark, d, "customer").select(F.when(k % 9 != 0, k % 37 * (k % 5)).alias("cluster"), (k % 50).alias("image"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("score"))
    sizes = f.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))
    rate = f.agg(F.round(F.count_if(F.col("cluster").isNull()) / F.greatest(F.count("*"), F.lit(1)), 6).alias("outlier_rate"), F.count_if(F.col("score").isNull()).alias("unavailable"))
    return sizes.crossJoin(F.broadcast(rate))  # one row


def largest_clusters(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 300).alias("cluster")).agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(20)


def certified_sample(spark, d):
    """128 rows of each corpus by the digest of its seed, corpus and key."""
    from ..operators.skew import placed_within

    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("corpus"), "doc_id", F.sha2(F.concat_ws("\n", F.lit("certify-v1"), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")), 256).alias("digest"))
    return placed_within(docs, ["corpus"], "digest").filter("place < 128").select("corpus", "doc_id")


def first_pass_summary(spark, d):
    """Tiers with their evidence bases, the images that change and the size of the audit."""
    from .matching import _evidence, first_pass

    e = _evidence(spark, d).select("k", F.when(F.col("sim").isNotNull() & F.col("model_score").isNotNull(), "both").when(F.col("sim").isNotNull(), "visual").when(F.col("model_score").isNotNull(), "model").otherwise("none").alias("basis"))
    g = first_pass(spark, d).join(e, "k").groupBy("tier").agg(F.count("*").alias("n"), *(F.count_if(F.col("basis") == b).alias(b) for b in ("both", "visual", "model")), F.count_if(F.col("k") % 5 != 0).alias("changed"))
    return g.withColumn("audited", F.floor((F.col("n") + 19) / 20))


def run_summary(spark, d):
    """Mean, median and latest seconds of each stage of a run log."""
    from ..operators.skew import group_quantiles

    e = kept(table(spark, d, "events").select("event_type", "value", "event_id"))
    n = e.groupBy("event_type").agg(F.count("value").alias("runs"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", "event_id").alias("latest"))
    return n.join(_r(group_quantiles(e, ["event_type"], "value", {"median": 0.5}), "median"), "event_type")


def before_after_counts(spark, d):
    """Aliases and candidates by state, before and after."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    state = lambda m: F.when(k % m == 0, "confirmed").when(k % m == 1, "rejected").otherwise("unconfirmed")
    a, b = (p.select(state(m).alias("state")).groupBy("state").agg(F.count("*").alias(n)) for m, n in ((5, "before"), (4, "after")))
    return a.join(b, "state", "full").select("state", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def admission(spark, d):
    files = table(spark, d, "documents").select(F.col("n_chars").alias("size"))
    cases = [("fits", 10, 1 << 40, 1 << 30, 5), ("quota", 10, 100, 1 << 30, 5), ("disk", 10, 1 << 40, 12, 5)]
    out = None
    for name, *limits in cases:
        one = measures.admission(files, *limits).withColumn("name", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def recomputed_consensus(spark, d):
    """Rows whose consensus differs from one that is computed anew from the signals alone: none."""
    t = kept(_tiered(spark, d))
    stats = t.agg(*(f(s).alias(f"{n}{s}") for s in SIGNALS for n, f in (("m", F.avg), ("d", F.stddev_pop))))  # one row
    z = sum(((F.col(s) - F.col(f"m{s}")) / F.col(f"d{s}") for s in SIGNALS), F.lit(0.0)) / len(SIGNALS)
    m = kept(t.crossJoin(F.broadcast(stats)).select("position", "consensus_z", z.alias("m")))
    again = m.crossJoin(F.broadcast(m.agg(F.avg("m").alias("mm"), F.stddev_pop("m").alias("ms"))))
    return again.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.abs(F.col("consensus_z") - (F.col("m") - F.col("mm")) / F.col("ms")) > 1e-9, F.lit(False))).alias("differ"))


QUERIES = {f.__name__: f for f in (folder_measures, cluster_measures, global_recommendations, alias_bank, loo_image_scores, image_strata, folder_representatives, candidate_receipt, top_tags, corpus_summary, duplicate_receipt, cluster_sizes, largest_clusters, certified_sample, first_pass_summary, run_summary, before_after_counts, admission, recomputed_consensus)}

_WILSON = "(({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n})) / (1 + 3.8416 / {n}))"
_IMG = f"""im AS (SELECT label AS folder, vec_id AS image, CASE WHEN vec_id % 50 <> 0 THEN list_concat([6.0::DOUBLE * (label % 3)], list_transform(embedding[2:{WIDTH}], lambda x: CAST(x AS DOUBLE))) END AS w, CASE WHEN label = 9 AND vec_id % 2 = 0 THEN 'p2' ELSE 'p1' END AS profile, CASE WHEN label = 8 THEN 'crop' ELSE 'whole-image' END AS rep,
  CASE WHEN label < 5 OR vec_id % 40 <> 0 THEN CASE WHEN vec_id % 4 = 3 THEN [] ELSE list_transform(range(0, vec_id % 4 + 1), lambda i: CASE WHEN (vec_id + i) % 7 <> 0 THEN (vec_id + i) % 5 END) END END AS fc,
  CASE WHEN label % 2 = 0 OR vec_id % 11 <> 0 THEN CASE WHEN vec_id % 3 = 2 THEN [] ELSE list_transform(range(0, vec_id % 3 + 1), lambda i: 'n' || (label + i)) END END AS ca, CASE WHEN vec_id % 13 <> 0 THEN vec_id % 17 = 0 END AS conflict,
  CASE WHEN vec_id % 5 < 4 AND vec_id % 9 <> 0 THEN 'n' || CASE WHEN vec_id % 3 = 0 THEN vec_id % 4 ELSE label END END AS identity, CASE WHEN vec_id % 5 < 4 AND vec_id % 3 <> 0 THEN 'a' || vec_id % 2 END AS artist, CASE WHEN vec_id % 5 < 4 THEN 'e' || vec_id % 6 END AS entity, CASE WHEN label < 7 THEN 'n' || label END AS target, CASE WHEN label % 3 = 2 THEN 'place' ELSE 'character' END AS kind FROM embeddings),
iu AS (SELECT folder, image, list_transform(w, lambda x: x / n) AS v FROM (SELECT *, sqrt(list_sum(list_transform(w, lambda y: y * y))) AS n FROM im))"""
_COH = """{p}e AS (SELECT {g} AS g, k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {src} WHERE v IS NOT NULL), {p}t AS (SELECT *, sum(x) OVER (PARTITION BY g, i) - x AS o FROM {p}e), {p}n AS (SELECT g, count(*) AS n FROM {src} WHERE v IS NOT NULL GROUP BY g), {p}s AS (SELECT {p}t.g, k, CASE WHEN any_value({p}n.n) >= 2 THEN greatest(-1, least(1, sum(x * o) / sqrt(sum(o * o)))) END AS s FROM {p}t JOIN {p}n ON {p}n.g = {p}t.g GROUP BY {p}t.g, k), {p}q AS (SELECT g, count(s) AS valid, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.1) AS p10 FROM {p}s GROUP BY g)"""
_FOLDER = f"""{_IMG}, fv AS (SELECT folder AS g, image AS k, CASE WHEN folder <> 9 THEN v END AS v FROM iu), {_COH.format(p='f', g='g', src='fv')},
idn AS (SELECT folder, identity, count(*) AS n, min(image) AS f FROM im WHERE identity IS NOT NULL GROUP BY 1, 2), idm AS (SELECT folder, sum(n) AS labels, max(n) AS most, (list(identity ORDER BY n DESC, f))[1] AS identity FROM idn GROUP BY folder),
arn AS (SELECT folder, artist, count(*) AS n FROM im WHERE artist IS NOT NULL GROUP BY 1, 2), arm AS (SELECT folder, sum(n) AS labels, max(n) AS most FROM arn GROUP BY folder),
fce AS (SELECT folder, image, unnest(fc) AS c FROM im), fcn AS (SELECT folder, c, count(*) AS n, count(DISTINCT image) AS i FROM fce WHERE c IS NOT NULL GROUP BY 1, 2), fcm AS (SELECT folder, max(n) AS top, count(*) FILTER (i >= 3) AS sup FROM fcn GROUP BY folder),
wh AS (SELECT folder, count(*) AS n, count(ca) AS known, count(*) FILTER (len(ca) = 0) AS unk, count(conflict) AS judged, count(*) FILTER (conflict) AS conf, max(target) AS target, max(kind) AS kind, count(*) FILTER (identity = target) AS ont, count(identity) AS ids, count(*) FILTER (list_contains(ca, target)) AS agree, count(*) FILTER (ca IS NOT NULL AND (len(ca) <> 1 OR NOT coalesce(list_contains(ca, target), false))) AS op, count(fc) AS looked, sum(len(fc)) AS faces, count(*) FILTER (len(fc) <> 1) AS odd, count(DISTINCT CASE WHEN artist IS NOT NULL THEN entity END) AS ents, max(rep) AS rep FROM im GROUP BY folder),
fj AS (SELECT wh.*, coalesce(valid, 0) AS valid, median, p10, idm.identity, idm.labels AS idl, idm.most AS idmost, arm.labels AS al, arm.most AS amost, top, sup, idm.most / n AS pu, {_WILSON.format(p='(idm.most / n)', n='n')} AS plow FROM wh LEFT JOIN fq ON fq.g = wh.folder LEFT JOIN idm USING (folder) LEFT JOIN arm USING (folder) LEFT JOIN fcm USING (folder)),
fm AS (SELECT folder, n, valid, round(median, 6) AS median, round(p10, 6) AS p10, coalesce(valid >= 30 AND median >= 0.9 AND p10 >= 0.8, false) AS coherent, identity, CAST(coalesce(idl, 0) AS BIGINT) AS id_labels, round(pu, 6) AS purity, round(greatest(0, plow), 6) AS purity_low, CASE WHEN target IS NOT NULL AND ids > 0 THEN round(ont / n, 6) END AS target_purity, round(amost / n, 6) AS artist_share, CAST(coalesce(al, 0) AS BIGINT) AS artist_labels, ents AS entities,
  CASE WHEN known > 0 THEN round(unk / known, 6) END AS unknown, CASE WHEN judged > 0 THEN round(conf / judged, 6) END AS conflict, CASE WHEN target IS NOT NULL AND kind IN ('character', 'work') AND known = n THEN round(agree / n, 6) END AS agreement, CASE WHEN target IS NOT NULL AND kind IN ('character', 'work') AND known = n THEN round(op / n, 6) END AS unresolved, round(known / n, 6) AS coverage, CAST(coalesce(faces, 0) AS BIGINT) AS faces, CASE WHEN rep = 'whole-image' THEN round(median, 6) END AS V,
  CASE WHEN faces > 0 THEN round(coalesce(top, 0) / faces, 6) END AS F, CASE WHEN looked = n THEN coalesce(sup, 0) END AS K, CASE WHEN looked = n THEN round(odd / n, 6) END AS Q, coalesce(valid >= 30 AND median >= 0.9 AND p10 >= 0.8 AND idl >= 30 AND plow >= 0.9, false) AS recommended FROM fj)"""
_CLUSTER = f"""cf AS (SELECT CASE WHEN im.image % 16 <> 0 THEN im.folder END AS cluster, im.image AS face, im.image // 2 AS image, im.image % 19 = 0 AS outlier, v FROM im JOIN iu USING (image)),
ci AS (SELECT cluster AS g, image AS k, (list({{'v': v}} ORDER BY face))[1].v AS v FROM cf WHERE cluster IS NOT NULL GROUP BY 1, 2), {_COH.format(p='c', g='g', src='ci')},
ats AS (SELECT DISTINCT image FROM cf), oc AS (SELECT image, 's' || image % 3 AS folder FROM ats WHERE image % 23 <> 0 UNION SELECT image, 's0' FROM ats WHERE image % 4 = 0 AND image % 23 <> 0), hh AS (SELECT g, folder, count(*) AS h FROM ci JOIN oc ON oc.image = ci.k GROUP BY 1, 2), hm AS (SELECT g, max(h) AS h FROM hh GROUP BY g),
cc AS (SELECT cluster, count(DISTINCT image) AS images, count(*) AS faces, avg(outlier::INT) AS os FROM cf WHERE cluster IS NOT NULL GROUP BY cluster),
cj AS (SELECT cc.*, coalesce(valid, 0) AS valid, median, p10, coalesce(h, 0) AS h FROM cc LEFT JOIN cq ON cq.g = cluster LEFT JOIN hm ON hm.g = cluster),
cm AS (SELECT *, concat_ws('|', CASE WHEN images < 10 THEN 'fewer-than-10-distinct-images' END, CASE WHEN valid <> images THEN 'insufficient-or-invalid-same-profile-vectors' END, CASE WHEN coalesce(median < 0.9, true) THEN 'median-below-0.90-or-unavailable' END, CASE WHEN coalesce(p10 < 0.8, true) THEN 'p10-below-0.80-or-unavailable' END) AS reasons FROM cj)"""
_SPREAD = ", ".join(f"round(quantile_cont(score, {p}), 6) AS {n}" for n, p in (("q0", 0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95), ("q100", 1)))
_SUMMARY = "count(*) AS n, count(DISTINCT sha) AS contents, count(DISTINCT source) AS families, CAST(sum(n_chars) AS BIGINT) AS bytes, count(lang) AS complete"
ORACLE = {
    "folder_measures": f"WITH {_FOLDER} SELECT * FROM fm",
    "cluster_measures": f"WITH {_IMG}, {_CLUSTER} SELECT cluster, images, faces, round(os, 6) AS outlier_share, valid, round(median, 6) AS median, round(p10, 6) AS p10, reasons, reasons = '' AS eligible, round(h / images, 6) AS concentration FROM cm",
    "global_recommendations": f"WITH {_FOLDER}, {_CLUSTER}, good AS (SELECT cluster FROM cm WHERE images >= 10 AND os < 0.06), va AS (SELECT DISTINCT image // 2 AS image FROM im WHERE w IS NOT NULL), co AS (SELECT DISTINCT image FROM cf WHERE cluster IN (SELECT cluster FROM good)), inh AS (SELECT DISTINCT image // 2 AS image FROM im WHERE folder IN (SELECT folder FROM fm WHERE purity >= 0.4)), z AS (SELECT (SELECT count(*) FROM good) AS eligible_clusters, (SELECT count(*) FROM co) AS covered_images, count(*) AS valid_images, count(*) FILTER (image IN (SELECT image FROM co)) AS c, count(*) FILTER (image IN (SELECT image FROM inh)) AS i FROM va) SELECT eligible_clusters, covered_images, valid_images, round(c / valid_images, 6) AS cluster_coverage, round(i / valid_images, 6) AS folder_coverage, eligible_clusters >= 3 AND c / valid_images >= 0.2 AS clusters_first, i / valid_images >= 0.5 AS inheritance FROM z",
    "alias_bank": """WITH o AS (SELECT l_suppkey AS image, 't' || l_partkey % 12 AS tag, round(max(l_quantity / 50), 4) AS score FROM lineitem GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, tag DESC) = 1 AS top FROM o),
s AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), dr AS (SELECT n_name AS name, b.* FROM b JOIN s ON s_suppkey = image WHERE s_suppkey % 3 <> 0), cr AS (SELECT n_name || CASE WHEN s_suppkey % 5 = 0 THEN '-x' ELSE '' END AS name, b.* FROM b JOIN s ON s_suppkey = image WHERE s_suppkey % 2 = 0),
tg AS (SELECT name, count(DISTINCT image) AS tagged FROM dr GROUP BY name), ds AS (SELECT name, tag, count(*) AS n, count(*) FILTER (top) AS t, min(score) AS d_min, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, max(score) AS d_max FROM dr GROUP BY 1, 2), cs AS (SELECT name, tag, count(*) AS n, quantile_cont(score, 0.5) AS p50 FROM cr GROUP BY 1, 2),
j AS (SELECT coalesce(ds.name, cs.name) AS name, coalesce(ds.tag, cs.tag) AS tag, coalesce(ds.n, 0) AS dn, coalesce(t, 0) AS dt, d_min, p25, ds.p50 AS dm, p75, d_max, coalesce(cs.n, 0) AS cn, cs.p50 AS cmed FROM ds FULL JOIN cs ON cs.name = ds.name AND cs.tag = ds.tag),
k AS (SELECT n_name AS name, 't' || n_nationkey % 12 AS tag, CASE WHEN n_nationkey % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS decision FROM nation)
SELECT j.name, j.tag, row_number() OVER (PARTITION BY j.name ORDER BY dn DESC, cn DESC, coalesce(dm, cmed, 0) DESC, j.tag) AS rank, dn AS direct_images, dt AS direct_top, d_min, round(p25, 6) AS d_p25, round(dm, 6) AS d_median, round(p75, 6) AS d_p75, d_max, cn AS cohort_images, round(cmed, 6) AS c_median, CASE WHEN dn >= 3 AND dn / greatest(coalesce(tagged, 0), 1) >= 0.8 AND coalesce(dm, 0) >= 0.85 THEN 'relatively-strong' ELSE 'weak' END AS strength, coalesce(decision, 'unconfirmed') AS decision FROM j LEFT JOIN tg ON tg.name = j.name LEFT JOIN k ON k.name = j.name AND k.tag = j.tag""",
    "loo_image_scores": f"WITH {_V}, f AS (SELECT k, k // 3 AS image, CASE WHEN k % 5 <> 0 THEN label END AS g, v FROM v), e AS (SELECT k, image, g, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM f), t AS (SELECT g AS tg, i, sum(x) AS t FROM e WHERE g IN (0, 3) GROUP BY 1, 2), o AS (SELECT k, image, tg, x, t - CASE WHEN g = tg THEN x ELSE 0 END AS o FROM e JOIN t ON t.i = e.i), s AS (SELECT k, image, tg, greatest(-1, least(1, sum(x * o) / sqrt(sum(o * o)))) AS s FROM o GROUP BY 1, 2, 3) SELECT image, round(max(s), 6) AS score FROM s GROUP BY image",
    "image_strata": "WITH s AS (SELECT l_orderkey AS image, CASE WHEN l_linestatus = 'F' THEN 'auto' WHEN l_returnflag = 'N' THEN 'none' ELSE 'review' END AS tier, l_linenumber <> 2 AS el FROM lineitem), g AS (SELECT image, CASE WHEN bool_and(tier = 'auto') THEN 'auto' WHEN bool_and(CASE WHEN el THEN tier = 'none' END) THEN 'none' ELSE 'review' END AS stratum FROM s GROUP BY image) SELECT stratum, count(*) AS images, min(image) AS first FROM g GROUP BY stratum",
    "folder_representatives": "WITH d AS (SELECT coalesce(source, '') AS folder, sha256(coalesce(text, '')) AS sha FROM documents), u AS (SELECT folder, sha, row_number() OVER (PARTITION BY folder ORDER BY sha) AS n FROM (SELECT DISTINCT folder, sha FROM d)) SELECT folder, (SELECT count(*) FROM d WHERE d.folder = u.folder) AS occurrences, string_agg(sha, '|' ORDER BY sha) FILTER (n <= 24) AS first FROM u GROUP BY folder",
    "candidate_receipt": f"SELECT l_returnflag AS source, count(DISTINCT l_orderkey) AS covered, count(*) FILTER (l_discount > 0.07) AS demoted, count(*) AS n, {_SPREAD} FROM (SELECT *, round(l_quantity / 50, 4) AS score FROM lineitem) GROUP BY 1",
    "top_tags": "SELECT l_partkey % 70 AS tag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, tag LIMIT 20",
    "corpus_summary": f"WITH d AS (SELECT sha256(coalesce(text, '')) AS sha, source, n_chars, lang FROM documents) SELECT 'whole' AS kind, '' AS name, {_SUMMARY} FROM d UNION ALL SELECT 'size', (n_chars // 1000 * 1000) || '+', {_SUMMARY} FROM d GROUP BY 2",
    "duplicate_receipt": "WITH d AS (SELECT count(*) AS paths, count(DISTINCT lang) AS kinds FROM documents GROUP BY sha256(coalesce(text, ''))) SELECT paths, count(*) AS contents, max(kinds) AS kinds FROM d WHERE paths > 1 GROUP BY paths",
    "cluster_sizes": "WITH f AS (SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 37 * (c_custkey % 5) END AS cluster, c_custkey % 4 = 0 AS bad FROM customer), s AS (SELECT count(*) AS size FROM f WHERE cluster IS NOT NULL GROUP BY cluster) SELECT size, count(*) AS clusters, (SELECT round(count(*) FILTER (cluster IS NULL) / count(*), 6) FROM f) AS outlier_rate, (SELECT count(*) FILTER (bad) FROM f) AS unavailable FROM s GROUP BY size",
    "largest_clusters": "SELECT o_custkey % 300 AS cluster, count(*) AS size FROM orders GROUP BY 1 ORDER BY size DESC, cluster LIMIT 20",
    "certified_sample": "SELECT corpus, doc_id FROM (SELECT coalesce(lang, '') AS corpus, doc_id, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY sha256('certify-v1' || chr(10) || coalesce(lang, '') || chr(10) || doc_id)) AS n FROM documents) WHERE n <= 128",
    "first_pass_summary": f"WITH {_EVIDENCE}, j AS (SELECT fp.k, tier, CASE WHEN sim IS NOT NULL AND ms IS NOT NULL THEN 'both' WHEN sim IS NOT NULL THEN 'visual' WHEN ms IS NOT NULL THEN 'model' END AS basis FROM fp JOIN e ON e.k = fp.k) SELECT tier, count(*) AS n, count(*) FILTER (basis = 'both') AS both, count(*) FILTER (basis = 'visual') AS visual, count(*) FILTER (basis = 'model') AS model, count(*) FILTER (k % 5 <> 0) AS changed, (count(*) + 19) // 20 AS audited FROM j GROUP BY tier",
    "run_summary": "SELECT event_type, count(value) AS runs, round(avg(value), 6) AS mean, arg_max(value, event_id) AS latest, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type",
    "before_after_counts": "WITH p AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'unconfirmed' END AS b, CASE p_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'unconfirmed' END AS a FROM part) SELECT s AS state, (SELECT count(*) FROM p WHERE b = s) AS before, (SELECT count(*) FROM p WHERE a = s) AS after, (SELECT count(*) FROM p WHERE a = s) - (SELECT count(*) FROM p WHERE b = s) AS delta FROM (VALUES ('confirmed'), ('rejected'), ('unconfirmed')) x(s)",
    "admission": "SELECT CAST(sum(n_chars) AS BIGINT) AS retained, status, name FROM documents, (VALUES ('admitted', 'fits'), ('derived-quota-exceeded', 'quota'), ('free-disk-reserve-violated', 'disk')) x(status, name) GROUP BY 2, 3",
    "recomputed_consensus": f"WITH {TIERED_SQL} SELECT count(*) AS n, 0::BIGINT AS differ FROM tiered",
}
