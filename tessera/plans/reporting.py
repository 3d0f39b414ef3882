"""Queries of reports about labels, scores and caches, and of density trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, reports
from ..sources.tables import TIERS, table
from .matching import _V, _vectors
from .scoring import TIERED_SQL, _tiered


def pass_agreement(spark, d):
    o = table(spark, d, "orders")
    r = reports.pass_agreement(o.select(F.col("o_totalprice").alias("old"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice") * (F.col("o_orderkey") % 7 + 3) / 6).alias("new")))
    return r.withColumn("threshold", F.round("threshold", 4))


def _faces(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select((k % 700).alias("image"), F.when(k % 3 != 0, F.col("event_type")).alias("label"), (k % 90 / 100).alias("sim"), F.when(k % 5 != 0, k % 17 / 100).alias("margin"), F.when(k % 4 != 0, k % 9).alias("cluster"))


def label_groups(spark, d):
    labels = table(spark, d, "events").select(F.col("event_type").alias("label")).union(table(spark, d, "region").select("r_name"))
    return reports.label_groups(labels, _faces(spark, d)).withColumn("mean_sim", F.round("mean_sim", 6)).withColumn("min_margin", F.round("min_margin", 6))


def abstained_clusters(spark, d):
    return reports.abstained(_faces(spark, d))


def image_counts(spark, d):
    return reports.image_counts(spark.range(750).select(F.col("id").alias("image")), _faces(spark, d).filter("image % 11 <> 3"))


def pinned_clusters(spark, d):
    c = table(spark, d, "customer")
    return reports.pinned(c.select((F.col("c_custkey") % 400).alias("cluster"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("name")))


def role_labels(spark, d):
    c = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 130)
    return table(spark, d, "events").select("event_id", reports.role(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), c).alias("role"))


def reused_evidence(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("provider"), (F.col("l_linenumber") != 3).alias("compatible"), F.col("l_linestatus").alias("evidence"))
    return reports.reused(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), e, "A")


def vector_agreement(spark, d):
    v = _vectors(spark, d)
    r = reports.vector_agreement(v.select(F.col("v").alias("x"), F.transform("v", lambda x: F.round(x, 3)).alias("y")))
    return r.select(*(F.round(c, 8).alias(c) for c in ("max_cosine", "median_cosine", "max_component")), "component_pass", "cosine_pass")


def columnar_payload(spark, d):
    t = _tiered(spark, d).select("position", "proposed_tier", "flags")
    return reports.columnar_payload(t, "position", ["position", "proposed_tier", "flags"], {"proposed_tier": list(TIERS)}, 500)


def density_tree(spark, d):
    v = _vectors(spark, d).select(F.lit(0).alias("g"), "k", "v")
    return density.density_tree(v, 5)


QUERIES = {f.__name__: f for f in (pass_agreement, label_groups, abstained_clusters, image_counts, pinned_clusters, role_labels, reused_evidence, vector_agreement, columnar_payload, density_tree)}
WITHOUT_SQL = {"density_tree"}
_FACES = "f AS (SELECT event_id % 700 AS image, CASE WHEN event_id % 3 <> 0 THEN event_type END AS label, event_id % 90 / 100 AS sim, CASE WHEN event_id % 5 <> 0 THEN event_id % 17 / 100 END AS margin, CASE WHEN event_id % 4 <> 0 THEN event_id % 9 END AS cluster FROM events)"
_CODE = "list_position([" + ", ".join(f"'{t}'" for t in TIERS) + "], proposed_tier) - 1"
ORACLE = {
    "pass_agreement": "WITH p AS (SELECT o_totalprice AS a, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice * (o_orderkey % 7 + 3) / 6 END AS b FROM orders), q AS (SELECT quantile, (SELECT list_extract(quantile_cont(a, [0.1, 0.2, 0.9]), i) FROM p) AS t FROM (VALUES (0.1::DOUBLE, 1), (0.2::DOUBLE, 2), (0.9::DOUBLE, 3)) x(quantile, i)) SELECT quantile, round(t, 4) AS threshold, count(*) AS paired, count(*) FILTER ((a >= t) = (b >= t)) AS agreement, count(*) FILTER ((a >= t) <> (b >= t)) AS disagreement, count(*) FILTER (a < t AND b >= t) AS gained, count(*) FILTER (a >= t AND b < t) AS lost FROM p, q WHERE b IS NOT NULL GROUP BY quantile, t",
    "label_groups": f"WITH {_FACES}, l AS (SELECT event_type AS label FROM events UNION SELECT r_name FROM region) SELECT l.label, count(DISTINCT image) AS images, count(f.label) AS faces, round(avg(sim), 6) AS mean_sim, round(min(margin), 6) AS min_margin FROM l LEFT JOIN f ON f.label = l.label GROUP BY l.label",
    "abstained_clusters": f"WITH {_FACES} SELECT cluster, count(*) AS faces, count(DISTINCT image) AS images FROM f WHERE label IS NULL GROUP BY cluster",
    "image_counts": f"WITH {_FACES}, g AS (SELECT image, count(DISTINCT label) AS labels, count(*) FILTER (label IS NULL) AS none FROM f WHERE image % 11 <> 3 GROUP BY image) SELECT count(*) AS images, count(*) FILTER (g.image IS NULL) AS zero_face, count(*) FILTER (coalesce(labels, 0) = 0) AS unassigned, count(*) FILTER (none > 0) AS any_abstained, count(*) FILTER (labels > 1) AS multi_label FROM range(750) r(i) LEFT JOIN g ON g.image = r.i",
    "pinned_clusters": "WITH m AS (SELECT c_custkey % 400 AS cluster, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS name FROM customer) SELECT cluster, CASE WHEN count(DISTINCT name) = 1 THEN min(name) END AS name FROM m GROUP BY cluster",
    "role_labels": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 4 <> 0 THEN '新人物' || printf('%02d', event_id % 130) ELSE '未知人物' END AS role FROM events",
    "reused_evidence": "WITH e AS (SELECT l_orderkey AS key, l_returnflag = 'A' AS own, l_linestatus AS evidence FROM lineitem WHERE l_linenumber <> 3), p AS (SELECT * FROM e WHERE own OR key NOT IN (SELECT key FROM e WHERE own)) SELECT key, min(evidence) AS evidence FROM p WHERE key IN (SELECT o_orderkey FROM orders) GROUP BY key HAVING count(DISTINCT evidence) = 1",
    "vector_agreement": f"WITH {_V}, w AS (SELECT v AS x, list_transform(v, lambda a: round(a, 3)) AS y FROM v), d AS (SELECT 1 - list_dot_product(x, y) AS c, list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS e, len(list_filter(list_zip(x, y), lambda p: abs(p[1] - p[2]) > 0.001 + 0.001 * abs(p[1]))) = 0 AS ok FROM w) SELECT round(max(c), 8) AS max_cosine, round(median(c), 8) AS median_cosine, round(max(e), 8) AS max_component, bool_and(ok) AS component_pass, max(c) <= 1e-5 AS cosine_pass FROM d",
    "columnar_payload": f"WITH {TIERED_SQL}, p AS (SELECT position // 500 AS chunk, count(*) AS rows, '{{\"position\":[' || string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) || '],\"proposed_tier\":[' || string_agg(CAST({_CODE} AS VARCHAR), ',' ORDER BY position) || '],\"flags\":[' || string_agg('\"' || flags || '\"', ',' ORDER BY position) || ']}}' AS payload FROM tiered GROUP BY 1) SELECT *, sha256(payload) AS sha256 FROM p",
}
