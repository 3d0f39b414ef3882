"""Queries of vectors and banks: reference scores, near-duplicates, clusters, grouping, candidates, first pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import unit, wilson
from ..operators import grouping, neardup, policy
from ..operators.metric import hamming_pairs, similar_pairs
from ..operators.skew import kept
from ..sources.tables import table

WIDTH = 64


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "label", unit(F.col("embedding")).alias("v")).filter("v IS NOT NULL")


def _bank(spark, d):
    return _vectors(spark, d).select(F.col("label").cast("string").alias("label"), F.col("k").alias("crop"), "v")


_V = "v AS (SELECT vec_id AS k, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


def reference_similarity(spark, d):
    v = _vectors(spark, d)
    s = grouping.reference_scores(v, v.filter("label = 0"))
    return s.select("k", *(F.round(c, 6).alias(c) for c in ("top_mean", "best", "novelty")))


def near_duplicate_pairs(spark, d):
    bits = F.array_join(F.transform("v", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    hexed = F.concat(*(F.lower(F.conv(F.substring(bits, 4 * i + 1, 4), 2, 16)) for i in range(WIDTH // 4)))
    return hamming_pairs(_vectors(spark, d).select("k", hexed.alias("v")), 15).withColumnRenamed("w", "distance")


def similarity_components(spark, d):
    v = _vectors(spark, d)
    return neardup.components(v, kept(similar_pairs(v, 0.38)))


def density_clusters(spark, d):
    v = _vectors(spark, d)
    return neardup.dbscan(v, 0.66, 4)


def group_decisions(spark, d):
    q = _vectors(spark, d).select("k", F.col("k").alias("crop"), "v")
    s = grouping.decide(grouping.label_scores(q, _bank(spark, d), WIDTH), 0.30, 0.02)
    return s.select("k", "label", F.round("sim", 6).alias("sim"), F.round("margin", 6).alias("margin"))


def bank_calibration(spark, d):
    return grouping.calibrate(_bank(spark, d), WIDTH).select("used", "stable", *(F.round(c, 6).alias(c) for c in ("genuine", "min_sim", "min_margin")))


def group_coherence(spark, d):
    s = grouping.loo_coherence(_vectors(spark, d).select(F.col("label").alias("g"), "k", "v"), WIDTH)
    return s.select("g", "denominator", "valid", "missing", F.round("median", 6).alias("median"), F.round("p10", 6).alias("p10"))


def _candidates(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_partkey").cast("string").alias("name")).agg(F.max(F.round(F.col("l_quantity") / 50, 4)).alias("score"))


def top_candidates(spark, d):
    return policy.top_candidates(_candidates(spark, d), 5)


def model_proposals(spark, d):
    return policy.propose(_candidates(spark, d))


def _evidence(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("k"), (k % 4).alias("rivals"), F.when(k % 9 != 0, (k * 7 % 40 - 5) / 100).alias("margin"), (k % 5 != 0).alias("supported"), (k % 11 != 0).alias("calibrated"),
        F.when(k % 3 != 0, (850 + k * 29 % 150) / 1000).alias("sim"), F.array(F.when(k % 13 == 0, F.lit("state-conflict"))).alias("conflicts"),
        F.when(k % 2 == 0, (k * 17 % 100) / 100).alias("model_score"), F.when(k % 6 == 0, (k * 19 % 60) / 100).alias("model_next"), (k % 8 != 0).alias("model_agrees"),
    )


_EVIDENCE = """e AS (SELECT p_partkey AS k, p_partkey % 4 AS rivals, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey * 7 % 40 - 5) / 100 END AS margin, p_partkey % 5 <> 0 AS supported, p_partkey % 11 <> 0 AS calibrated,
  CASE WHEN p_partkey % 3 <> 0 THEN (850 + p_partkey * 29 % 150) / 1000 END AS sim, p_partkey % 13 = 0 AS conflict, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 17 % 100) / 100 END AS ms, CASE WHEN p_partkey % 6 = 0 THEN (p_partkey * 19 % 60) / 100 END AS mn, p_partkey % 8 <> 0 AS agrees FROM part),
f AS (SELECT *, list_filter([CASE WHEN conflict THEN 'state-conflict' END, CASE WHEN ms IS NOT NULL AND NOT agrees THEN 'model_demoted' END,
  CASE WHEN sim IS NOT NULL AND NOT rivals >= 2 THEN 'insufficient-competing-identities' END, CASE WHEN sim IS NOT NULL AND NOT coalesce(margin > 0, false) THEN 'ambiguous-or-disagreeing-winners' END, CASE WHEN sim IS NOT NULL AND NOT supported THEN 'human-support-required' END,
  CASE WHEN sim IS NOT NULL AND NOT calibrated THEN 'calibration-required' END, CASE WHEN sim < 0.9 THEN 'similarity-below-policy' END, CASE WHEN sim IS NOT NULL AND NOT coalesce(margin >= 0.05, false) THEN 'margin-below-policy' END], lambda x: x IS NOT NULL) AS first FROM e),
g AS (SELECT *, sim IS NOT NULL AND len(first) = 0 AS auto, list_concat(first, CASE WHEN ms > 0.35 THEN [CASE WHEN ms >= 0.85 AND ms - coalesce(mn, 0.35) >= 0.2 THEN 'model-only-hypothesis' ELSE 'enumerated-model-candidate' END] ELSE [] END) AS rest FROM f),
fp AS (SELECT k, CASE WHEN auto THEN 'auto' WHEN sim IS NOT NULL OR len(rest) > 0 THEN 'review' ELSE 'none' END AS tier, CASE WHEN auto THEN 'reference-gates-passed' WHEN sim IS NOT NULL OR len(rest) > 0 THEN array_to_string(rest, '|') ELSE 'no-actionable-evidence' END AS reasons FROM g)"""


def first_pass(spark, d):
    return policy.first_pass(_evidence(spark, d))


def first_pass_reasons(spark, d):
    return first_pass(spark, d).select("tier", F.explode(F.split("reasons", r"\|")).alias("reason")).groupBy("tier", "reason").agg(F.count("*").alias("n"))


def first_pass_audit(spark, d):
    return policy.audit(first_pass(spark, d).filter("tier <> 'review'").select("k", "tier"), "snapshot-1")


def label_intervals(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("toxic").alias("n"), F.count("*").alias("population"), F.sum("toxic").alias("x"))
    return g.select("lang", "n", "population", wilson(F.col("x"), F.col("n"), F.col("population")).alias("w")).select("lang", "n", "population", *(F.round(f"w.{c}", 6).alias(c) for c in ("value", "low", "high")), "w.method")


def _features(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k, (k * 7 % 60).alias("valid_images"), (k * 11 % 50).alias("eligible_faces"), F.when(k % 5 != 0, (k * 13 % 101) / 100).alias("v"), F.when(k % 7 != 0, (k * 29 % 101) / 100).alias("f"), (k % 6).alias("k"), F.when(k % 4 != 0, (k * 31 % 101) / 100).alias("q"), F.when(k % 9 != 0, (k * 17 % 101) / 100).alias("a"), (k * 3 % 50).alias("artist_labels"), (k % 8).alias("entities"))


def folder_regimes(spark, d):
    return policy.regimes(_features(spark, d)).select("s_suppkey", "s0", "s1", "s2", "s3", "passing", "status")


_REGIME = lambda *g: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in g)} THEN 'unavailable' WHEN {' AND '.join(g)} THEN 'pass' ELSE 'fail' END"


def state_roll_up(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_id") % 37 == 0, "pending").when(F.col("event_id") % 23 == 0, "deferred").otherwise("resolved").alias("state"))
    return policy.roll_up(e)


QUERIES = {f.__name__: f for f in (reference_similarity, near_duplicate_pairs, similarity_components, density_clusters, group_decisions, bank_calibration, group_coherence, top_candidates, model_proposals, first_pass, first_pass_reasons, first_pass_audit, label_intervals, folder_regimes, state_roll_up)}

_SCORES = f"""{_V}, bank AS (SELECT CAST(label AS VARCHAR) AS label, k AS crop, v FROM v),
be AS (SELECT label, crop, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM bank),
tot AS (SELECT label, i, sum(x) AS t FROM be GROUP BY label, i),
qe AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
own AS (SELECT label, crop, i, x FROM be),
ce AS (SELECT q.k, t.label, q.x AS qx, t.t - coalesce(o.x, 0) AS c FROM qe q JOIN tot t ON t.i = q.i LEFT JOIN own o ON o.label = t.label AND o.crop = q.k AND o.i = q.i),
cen AS (SELECT k, label, greatest(-1, least(1, sum(qx * c) / sqrt(sum(c * c)))) AS centre FROM ce GROUP BY k, label),
ind AS (SELECT v.k, bank.label, greatest(-1, least(1, max(list_dot_product(v.v, bank.v)))) AS individual FROM v JOIN bank ON bank.crop <> v.k GROUP BY v.k, bank.label),
sc AS (SELECT cen.k, cen.label, centre, individual FROM cen JOIN ind ON ind.k = cen.k AND ind.label = cen.label),
mg AS (SELECT a.*, (SELECT max(b.centre) FROM sc b WHERE b.k = a.k AND b.label <> a.label) AS wrong, (SELECT max(b.individual) FROM sc b WHERE b.k = a.k AND b.label <> a.label) AS wrong_i FROM sc a),
mm AS (SELECT *, least(centre - wrong, individual - wrong_i) AS margin FROM mg)"""
_CAND = "c AS (SELECT l_orderkey AS k, CAST(l_partkey AS VARCHAR) AS name, max(round(l_quantity / 50, 4)) AS score FROM lineitem GROUP BY 1, 2)"
_FEATURES = "f AS (SELECT s_suppkey, s_suppkey * 7 % 60 AS vi, s_suppkey * 11 % 50 AS ef, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 13 % 101) / 100 END AS v, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 29 % 101) / 100 END AS f, s_suppkey % 6 AS k, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey * 31 % 101) / 100 END AS q, CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey * 17 % 101) / 100 END AS a, s_suppkey * 3 % 50 AS al, s_suppkey % 8 AS en FROM supplier)"
ORACLE = {
    "reference_similarity": f"WITH {_V}, s AS (SELECT a.k, greatest(-1, least(1, list_dot_product(a.v, b.v))) AS s FROM v a, v b WHERE b.label = 0), l AS (SELECT k, list_sort(list(s), 'DESC') AS t FROM s GROUP BY k) SELECT k, round(list_avg(t[1:3]), 6) AS top_mean, round(t[1], 6) AS best, round(1 - t[1], 6) AS novelty FROM l",
    "near_duplicate_pairs": f"WITH {_V}, b AS (SELECT k, list_transform(v, lambda x: x > 0) AS b FROM v) SELECT a.k AS a, c.k AS b, CAST(len(list_filter(list_zip(a.b, c.b), lambda p: p[1] <> p[2])) AS BIGINT) AS distance FROM b a JOIN b c ON a.k < c.k WHERE len(list_filter(list_zip(a.b, c.b), lambda p: p[1] <> p[2])) <= 15",
    "similarity_components": f"WITH RECURSIVE {_V}, e AS (SELECT a.k AS a, b.k AS b FROM v a, v b WHERE a.k <> b.k AND list_dot_product(a.v, b.v) >= 0.38), r AS (SELECT k AS n, k AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n) SELECT n AS k, min(c) AS component FROM r GROUP BY n",
    "density_clusters": f"WITH RECURSIVE {_V}, e AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM v a, v b WHERE a.k <> b.k AND 1 - list_dot_product(a.v, b.v) <= 0.66), core AS MATERIALIZED (SELECT k FROM v LEFT JOIN e ON e.a = v.k GROUP BY k HAVING count(e.a) + 1 >= 4), ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)), r AS (SELECT k AS n, k AS c FROM core UNION SELECT ce.b, r.c FROM r JOIN ce ON ce.a = r.n), m AS (SELECT n, min(c) AS c FROM r GROUP BY n), bo AS (SELECT e.a AS n, min(m.c) AS c FROM e JOIN m ON m.n = e.b WHERE e.a NOT IN (SELECT k FROM core) GROUP BY e.a) SELECT v.k, coalesce(m.c, bo.c) AS cluster, m.n IS NOT NULL AS core FROM v LEFT JOIN m ON m.n = v.k LEFT JOIN bo ON bo.n = v.k",
    "group_decisions": f"WITH {_SCORES}, b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY centre DESC, label) AS rn FROM mm) SELECT k, CASE WHEN centre >= 0.30 AND margin >= 0.02 AND margin > 0 THEN label END AS label, round(centre, 6) AS sim, round(margin, 6) AS margin FROM b WHERE rn = 1",
    "bank_calibration": f"WITH {_SCORES}, g AS (SELECT mm.* FROM mm JOIN bank ON bank.crop = mm.k AND bank.label = mm.label) SELECT count(*) AS used, count(*) FILTER (margin > 0) AS stable, round(quantile_cont(centre, 0.5), 6) AS genuine, round(quantile_cont(wrong, 0.95), 6) AS min_sim, round(greatest(0.005, quantile_cont(CASE WHEN margin > 0 THEN margin END, 0.1)), 6) AS min_margin FROM g",
    "group_coherence": f"WITH {_V}, e AS (SELECT label AS g, k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), t AS (SELECT *, sum(x) OVER (PARTITION BY g, i) - x AS o FROM e), s AS (SELECT g, k, greatest(-1, least(1, sum(x * o) / sqrt(sum(o * o)))) AS s FROM t GROUP BY g, k) SELECT g, count(*) AS denominator, count(s) AS valid, count(*) - count(s) AS missing, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.1), 6) AS p10 FROM s GROUP BY g",
    "top_candidates": f"WITH {_CAND} SELECT k, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, name) AS rank FROM c WHERE score > 0.35) WHERE rank <= 5",
    "model_proposals": f"WITH {_CAND}, r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nx FROM c WINDOW w AS (PARTITION BY k ORDER BY score DESC, name)) SELECT k, name, score, round(score - coalesce(nx, 0.35), 12) AS margin FROM r WHERE rn = 1 AND score >= 0.85 AND round(score - coalesce(nx, 0.35), 12) >= 0.2",
    "first_pass": f"WITH {_EVIDENCE} SELECT * FROM fp",
    "first_pass_reasons": f"WITH {_EVIDENCE} SELECT tier, reason, count(*) AS n FROM (SELECT tier, unnest(string_split(reasons, '|')) AS reason FROM fp) GROUP BY tier, reason",
    "first_pass_audit": f"WITH {_EVIDENCE}, a AS (SELECT tier, k, sha256('audit-v1' || chr(10) || 'snapshot-1' || chr(10) || tier || chr(10) || k) AS digest, count(*) OVER (PARTITION BY tier) AS n FROM fp WHERE tier <> 'review') SELECT tier, k, digest FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY digest, k) AS rn FROM a) WHERE rn <= floor((n + 19) / 20)",
    "label_intervals": "WITH g AS (SELECT lang, count(toxic) AS n, count(*) AS population, sum(toxic) AS x FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang), h AS (SELECT *, x / n AS p, 1.96 * 1.96 AS z2, x IS NULL OR n = 0 AS none, n = population AS census FROM g), i AS (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n) AS hf FROM h) SELECT lang, n, population, CASE WHEN NOT none THEN round(p, 6) END AS value, CASE WHEN NOT none AND NOT census THEN round(greatest(0, c - hf), 6) END AS low, CASE WHEN NOT none AND NOT census THEN round(least(1, c + hf), 6) END AS high, CASE WHEN none THEN 'unavailable' WHEN census THEN 'census-exact' ELSE 'Wilson-95%-z=1.96-SRS' END AS method FROM i",
    "folder_regimes": f"WITH {_FEATURES}, s AS (SELECT *, {_REGIME('vi >= 30', 'v >= 0.9', 'f >= 0.8', 'ef >= 30')} AS s0, {_REGIME('vi >= 30', 'v < 0.8', 'f < 0.5', 'k >= 3')} AS s1, {_REGIME('vi >= 30', 'v >= 0.85', 'q >= 0.5', 'f < 0.8')} AS s2, {_REGIME('vi >= 30', 'a >= 0.8', 'al >= 30', 'en >= 3')} AS s3 FROM f), p AS (SELECT *, concat_ws('|', CASE WHEN s0 = 'pass' THEN 'session-set' END, CASE WHEN s1 = 'pass' THEN 'mixed-pile' END, CASE WHEN s2 = 'pass' THEN 'scenario/documentary' END, CASE WHEN s3 = 'pass' THEN 'artist-portfolio' END) AS passing, (s0 = 'pass')::INT + (s1 = 'pass')::INT + (s2 = 'pass')::INT + (s3 = 'pass')::INT AS n FROM s) SELECT s_suppkey, s0, s1, s2, s3, passing, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'recommended' WHEN vi < 30 OR (s0 = 'unavailable' AND s1 = 'unavailable' AND s2 = 'unavailable' AND s3 = 'unavailable') THEN 'insufficient-evidence' ELSE 'undetermined' END AS status FROM p",
    "state_roll_up": "WITH e AS (SELECT user_id AS k, CASE WHEN event_id % 37 = 0 THEN 'pending' WHEN event_id % 23 = 0 THEN 'deferred' ELSE 'resolved' END AS s FROM events) SELECT k, CASE WHEN bool_or(s = 'pending') THEN 'pending' WHEN bool_or(s = 'deferred') THEN 'deferred' ELSE 'resolved' END AS disposition FROM e GROUP BY k",
}
