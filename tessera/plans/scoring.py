"""Queries of corpus scoring: tiers, families, thresholds, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hex_int
from ..operators.neardup import theta_families
from ..operators.ranking import champions, consensus, family_id, tiers, zscores
from ..operators.skew import group_quantiles, kept, placed, quantiles
from ..sources.tables import MANIFEST_SQL, TIERS, manifest, table

SIGNALS = ["s1", "s2", "s3", "s4"]


def _r(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def _families(rows):
    return theta_families(rows.select(F.col("position").alias("k"), "sha256", "hash", "v"))


def _tiered(spark, d):
    rows = kept(manifest(spark, d))
    return tiers(rows.join(_families(rows).select(F.col("k").alias("position"), "family_id"), "position"), SIGNALS)


def theta_families_of_parts(spark, d):
    return _families(kept(manifest(spark, d))).select(F.col("k").alias("position"), "component", "family_id")


def corpus_tiering(spark, d):
    return _tiered(spark, d).select("position", *_r("consensus_z", "disagreement"), "flags", "proposed_tier")


_Z = "CASE WHEN sd{0} > 1e-12 THEN (s{0} - m{0}) / sd{0} WHEN s{0} IS NOT NULL THEN 0.0 END"
FAMILIES_SQL = """hx AS (SELECT position, sha256, v, list_transform([1, 17, 33, 49], lambda i: ('0x' || substr(hash, i, 16))::UBIGINT) AS h FROM manifest),
hp AS (SELECT a.position AS a, b.position AS b, list_sum(list_transform(list_zip(a.h, b.h), lambda p: bit_count(xor(p[1], p[2])::BIT))) AS n, list_dot_product(a.v, b.v) AS c FROM hx a JOIN hx b ON a.position <> b.position),
he AS MATERIALIZED (SELECT a, b FROM hp WHERE n <= 6 OR n <= 10 AND c >= 0.96),
hr AS (SELECT position AS n, position AS c FROM manifest UNION SELECT he.b, hr.c FROM hr JOIN he ON he.a = hr.n),
hc AS (SELECT n AS position, min(c) AS component FROM hr GROUP BY n),
hf AS (SELECT component, sha256('["theta-v1",["' || string_agg(DISTINCT sha256, '","' ORDER BY sha256) || '"]]') AS family_id FROM hc JOIN manifest USING (position) GROUP BY component),
fam AS MATERIALIZED (SELECT position, component, family_id FROM hc JOIN hf USING (component))"""
TIERED_SQL = f"""RECURSIVE {MANIFEST_SQL}, {FAMILIES_SQL},
st AS (SELECT {', '.join(f'avg(s{i}) AS m{i}, stddev_pop(s{i}) AS sd{i}' for i in (1, 2, 3, 4))}, count(*) = count(s1) AND count(*) = count(s2) AND count(*) = count(s3) AND count(*) = count(s4) AS complete, count(*) = count(identity_sim) AS ids FROM manifest),
zz AS (SELECT manifest.*, complete, ids, {', '.join(_Z.format(i) + f' AS z{i}' for i in (1, 2, 3, 4))} FROM manifest, st),
mm AS (SELECT *, CASE WHEN complete THEN (z1 + z2 + z3 + z4) / 4 END AS m, CASE WHEN complete THEN sqrt(list_aggregate([z1, z2, z3, z4], 'var_pop')) END AS disagreement FROM zz),
cc AS (SELECT mm.*, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS consensus_z FROM mm),
pp AS (SELECT *, row_number() OVER w AS place, first_value(coalesce(consensus_z, 0)) OVER w AS champion_z FROM cc JOIN fam USING (position) WINDOW w AS (PARTITION BY family_id ORDER BY coalesce(consensus_z, 0) DESC, sha256, position)),
qq AS (SELECT CASE WHEN bool_and(ids) THEN quantile_cont(identity_sim, 0.1) END AS q_ir, CASE WHEN bool_and(ids) THEN quantile_cont(identity_sim, 0.2) END AS q_iq, quantile_cont(consensus_z, 0.9) AS q_q, quantile_cont(consensus_z, 0.75) AS q_r FROM pp),
ff AS (SELECT pp.*, qq.*, coalesce(nsfw_prob >= 0.65, false) AS is_nsfw, coalesce(identity_sim < q_ir AND (confusable_margin IS NULL OR confusable_margin < 0.05), false) AS is_low,
  list_filter([CASE WHEN s1 IS NULL THEN 'signal_unavailable:s1' END, CASE WHEN s2 IS NULL THEN 'signal_unavailable:s2' END, CASE WHEN s3 IS NULL THEN 'signal_unavailable:s3' END, CASE WHEN s4 IS NULL THEN 'signal_unavailable:s4' END,
    CASE WHEN NOT complete THEN 'quality_population_unavailable' END, CASE WHEN NOT ids THEN 'identity_population_unavailable' END,
    CASE WHEN disagreement > 1.2 THEN 'uncertain' END, CASE WHEN gaming_delta > 0.35 THEN 'gaming_suspect' END, CASE WHEN nsfw_prob >= 0.65 THEN 'nsfw' END, CASE WHEN complete AND place > 1 THEN 'near_dup_runnerup' END], lambda x: x IS NOT NULL) AS fl FROM pp, qq),
uu AS (SELECT *, coalesce(len(fl) = 0 AND consensus_z >= q_q AND nsfw_prob < 0.35 AND identity_sim >= q_iq AND (place = 1 OR champion_z - consensus_z <= 0.15), false) AS is_q, coalesce(len(fl) = 0 AND consensus_z < q_r, false) AS is_a, ('0x' || substr(sha256, 1, 8))::BIGINT % 20 = 0 AS is_s FROM ff),
tiered AS (SELECT *, CASE WHEN is_nsfw THEN 'route_nsfw' WHEN is_low THEN 'route_identity' WHEN is_q THEN 'queue' WHEN is_a AND NOT is_s THEN 'archive_candidate' ELSE 'review' END AS proposed_tier,
  array_to_string(list_concat(fl, CASE WHEN NOT is_nsfw AND is_low THEN ['id_low'] WHEN NOT is_nsfw AND NOT is_q AND is_a AND is_s THEN ['audit_sample'] ELSE [] END), '|') AS flags FROM uu)"""


def signal_zscores(spark, d):
    return zscores(manifest(spark, d), SIGNALS).select("position", *_r(*(f"z_{s}" for s in SIGNALS)))


def incomplete_cohort(spark, d):
    """Labels cover some documents only, so no consensus is issued for any."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("position"), F.col("n_chars").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))
    return consensus(rows, ["a", "b"]).select("position", "complete", "consensus_z", "disagreement")


def disagreement_with_sigma(spark, d):
    rows = manifest(spark, d).withColumn("sig", F.col("s1") / 10)
    return consensus(rows, SIGNALS, ("sig", "s1")).select("position", *_r("disagreement"))


def quantile_thresholds(spark, d):
    q = quantiles(table(spark, d, "orders"), "o_totalprice", {"p10": 0.1, "p20": 0.2, "p75": 0.75, "p90": 0.9})
    return q.select(*(F.round(c, 4).alias(c) for c in q.columns))


def family_champions(spark, d):
    rows = kept(manifest(spark, d))
    c = champions(consensus(rows.join(_families(rows).select(F.col("k").alias("position"), "family_id"), "position"), SIGNALS))
    return c.filter("place <= 2").select("family_id", "place", "position", *_r("consensus_z"))


def content_families(spark, d):
    docs = table(spark, d, "documents").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.groupBy("source").agg(family_id(F.collect_set("sha"), "content-v1").alias("family_id"), F.count_distinct("sha").alias("members"))


def tier_counts(spark, d):
    return _tiered(spark, d).groupBy("proposed_tier").agg(F.count("*").alias("n"))


def flag_counts(spark, d):
    return _tiered(spark, d).select(F.explode(F.split("flags", r"\|")).alias("flag")).filter("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def header_stats(spark, d):
    t = kept(_tiered(spark, d))
    kinds = spark.createDataFrame([(x,) for x in TIERS], "proposed_tier string")
    middle = group_quantiles(t, ["proposed_tier"], "consensus_z", {"median_z": 0.5})
    g = t.groupBy("proposed_tier").agg(F.count("*").alias("n"), F.round(F.avg("consensus_z"), 6).alias("mean_z")).join(middle, "proposed_tier", "left").withColumn("median_z", F.round("median_z", 6))
    total = t.agg(F.count("*").alias("total"))
    j = kinds.join(g, "proposed_tier", "left").crossJoin(F.broadcast(total))
    return j.select("proposed_tier", F.coalesce("n", F.lit(0)).alias("n"), "median_z", "mean_z", F.round(F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)), 6).alias("rate"))


def family_size_bins(spark, d):
    f = table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("f")).agg(F.count("*").alias("size"))
    return f.groupBy(F.when(F.col("size") == 1, "1").when(F.col("size") == 2, "2").when(F.col("size") <= 5, "3-5").when(F.col("size") <= 10, "6-10").otherwise("11+").alias("bin")).agg(F.count("*").alias("families"), F.sum("size").alias("members"))


def audit_hash_sample(spark, d):
    return manifest(spark, d).filter(hex_int(F.col("sha256")) % 5 == 0).select("position", F.substring("sha256", 1, 16).alias("sha16"))


def missing_signals(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("quality", "toxic", "lang")))), "|").alias("missing"))


def spotlights(spark, d):
    t = _tiered(spark, d)
    w = t.filter("flags LIKE '%uncertain%'").select(F.lit("uncertain").alias("kind"), "position", "consensus_z").orderBy(F.desc_nulls_last("consensus_z"), "position").limit(12)
    g = t.filter("gaming_delta > 0").select(F.lit("gaming").alias("kind"), "position", F.col("gaming_delta").alias("consensus_z")).orderBy(F.desc_nulls_last("consensus_z"), "position").limit(12)
    return w.union(g).select("kind", "position", F.round("consensus_z", 6).alias("value"))


def signal_correlation(spark, d):
    m = kept(manifest(spark, d).select("s1", "s2"))

    def ranked(c: str):
        """The mean rank of each value; equal values share it."""
        at = placed(m.select(c).filter(F.col(c).isNotNull()), c).groupBy(c).agg(((F.min("place") + F.max("place")) / 2 + 1).alias("r"))
        return at.select(F.col(c).alias(f"v_{c}"), F.col("r").alias(f"r_{c}"))

    j = m.join(ranked("s1"), F.col("s1") == F.col("v_s1")).join(ranked("s2"), F.col("s2") == F.col("v_s2"))
    return j.agg(F.round(F.corr("s1", "s2"), 6).alias("pearson"), F.round(F.corr("r_s1", "r_s2"), 6).alias("spearman"))


def tier_transitions(spark, d):
    t = _tiered(spark, d).select("position", F.col("proposed_tier").alias("new"))
    old = tiers(manifest(spark, d).withColumn("family_id", F.col("sha256")), SIGNALS).select("position", F.col("proposed_tier").alias("old"))
    return t.join(old, "position").groupBy("old", "new").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (corpus_tiering, theta_families_of_parts, signal_zscores, incomplete_cohort, disagreement_with_sigma, quantile_thresholds, family_champions, content_families, tier_counts, flag_counts, header_stats, family_size_bins, audit_hash_sample, missing_signals, spotlights, signal_correlation, tier_transitions)}
_W = f"WITH {TIERED_SQL} "
_KINDS = ", ".join(f"('{t}')" for t in TIERS)
ORACLE = {
    "corpus_tiering": _W + "SELECT position, round(consensus_z, 6) AS consensus_z, round(disagreement, 6) AS disagreement, flags, proposed_tier FROM tiered",
    "theta_families_of_parts": f"WITH RECURSIVE {MANIFEST_SQL}, {FAMILIES_SQL} SELECT position, component, family_id FROM fam",
    "signal_zscores": _W + "SELECT position, " + ", ".join(f"round(z{i}, 6) AS z_s{i}" for i in (1, 2, 3, 4)) + " FROM zz",
    "incomplete_cohort": "SELECT doc_id AS position, false AS complete, CAST(NULL AS DOUBLE) AS consensus_z, CAST(NULL AS DOUBLE) AS disagreement FROM documents",
    "disagreement_with_sigma": _W + "SELECT position, round(sqrt(list_aggregate([z1, z2, z3, z4], 'var_pop') + pow((s1 / 10) / sd1, 2) / 4), 6) AS disagreement FROM zz, st",
    "quantile_thresholds": "SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS {n}" for n, p in (("p10", 0.1), ("p20", 0.2), ("p75", 0.75), ("p90", 0.9))) + " FROM orders",
    "family_champions": _W + "SELECT family_id, place, position, round(consensus_z, 6) AS consensus_z FROM pp WHERE place <= 2",
    "content_families": """SELECT source, sha256('["content-v1",["' || string_agg(DISTINCT sha, '","' ORDER BY sha) || '"]]') AS family_id, count(DISTINCT sha) AS members FROM (SELECT source, sha256(coalesce(text, '')) AS sha FROM documents) GROUP BY source""",
    "tier_counts": _W + "SELECT proposed_tier, count(*) AS n FROM tiered GROUP BY proposed_tier",
    "flag_counts": _W + "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM tiered) WHERE flag <> '' GROUP BY flag",
    "header_stats": _W + f"SELECT k.t AS proposed_tier, count(proposed_tier) AS n, round(median(consensus_z), 6) AS median_z, round(avg(consensus_z), 6) AS mean_z, round(count(proposed_tier) / greatest((SELECT count(*) FROM tiered), 1), 6) AS rate FROM (VALUES {_KINDS}) k(t) LEFT JOIN tiered ON proposed_tier = k.t GROUP BY k.t",
    "family_size_bins": "SELECT CASE WHEN size = 1 THEN '1' WHEN size = 2 THEN '2' WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' ELSE '11+' END AS bin, count(*) AS families, CAST(sum(size) AS BIGINT) AS members FROM (SELECT count(*) AS size FROM documents GROUP BY sha256(coalesce(text, ''))) GROUP BY 1",
    "audit_hash_sample": f"WITH {MANIFEST_SQL} SELECT position, substr(sha256, 1, 16) AS sha16 FROM manifest WHERE ('0x' || substr(sha256, 1, 8))::BIGINT % 5 = 0",
    "missing_signals": "SELECT d.doc_id, concat_ws('|', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN lang IS NULL THEN 'lang' END) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "spotlights": _W + "SELECT * FROM (SELECT 'uncertain' AS kind, position, round(consensus_z, 6) AS value FROM tiered WHERE flags LIKE '%uncertain%' ORDER BY consensus_z DESC NULLS LAST, position LIMIT 12) UNION ALL SELECT * FROM (SELECT 'gaming', position, round(gaming_delta, 6) FROM tiered WHERE gaming_delta > 0 ORDER BY gaming_delta DESC NULLS LAST, position LIMIT 12)",
    "signal_correlation": f"WITH {MANIFEST_SQL}, r AS (SELECT s1, s2, rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2 AS r1, rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2 AS r2 FROM manifest WHERE s1 IS NOT NULL) SELECT round(corr(s1, s2), 6) AS pearson, round(corr(r1, r2), 6) AS spearman FROM r",
    "tier_transitions": f"WITH {TIERED_SQL}, o AS (SELECT position, CASE WHEN is_nsfw THEN 'route_nsfw' WHEN is_low THEN 'route_identity' WHEN n0 AND consensus_z >= q_q AND nsfw_prob < 0.35 AND identity_sim >= q_iq THEN 'queue' WHEN n0 AND consensus_z < q_r AND NOT is_s THEN 'archive_candidate' ELSE 'review' END AS old, proposed_tier AS new FROM (SELECT *, len(list_filter(fl, lambda x: x <> 'near_dup_runnerup')) = 0 AS n0 FROM tiered)) SELECT old, new, count(*) AS n FROM o GROUP BY old, new",
}
