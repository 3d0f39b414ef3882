"""Queries of order-dependent selection, cluster reports, move plans and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import displayed_rect
from ..operators import layout, ordered
from ..operators.metric import similar_pairs
from ..operators.skew import kept
from ..sources.tables import table
from .matching import _V, WIDTH, _vectors, near_duplicate_pairs

FOLDERS = {"queue": "keep", "route_nsfw": "private", "archive_candidate": "archive"}


def greedy_representatives(spark, d):
    return ordered.greedy_keep(_vectors(spark, d), near_duplicate_pairs(spark, d))


def representative_wall(spark, d):
    return ordered.representative_wall(_vectors(spark, d).select(F.col("label").alias("g"), "k", "v"), WIDTH)


def label_whispers(spark, d):
    v = _vectors(spark, d)
    links = kept(similar_pairs(v, 0.38))
    return ordered.whispers(v, links, 3)


def seeded_sample(spark, d):
    return ordered.seeded_sample(table(spark, d, "documents").select(F.col("source").alias("g"), F.sha2(F.col("doc_id").cast("string"), 256).alias("k")), 20260921)


def tag_projection(spark, d):
    li = table(spark, d, "lineitem")
    t = li.groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("category"), F.col("l_partkey").cast("string").alias("name")).agg(F.max(F.round(F.col("l_quantity") / 50, 4)).alias("score"))
    return ordered.best_tags(t, {"A": 5, "N": 40})


def cluster_report(spark, d):
    m = _vectors(spark, d).select("k", F.col("label").alias("cluster"), (F.col("k") % 10 / 10).alias("prob"), "v")
    r = ordered.cluster_report(m, WIDTH)
    return r.select("cluster_id", "cluster", "size", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("representatives", lambda x: x.cast("string")), "|").alias("representatives"), F.round("margin", 6).alias("margin"))


def move_targets(spark, d):
    o = table(spark, d, "orders")
    path = F.concat(F.lit("root/c"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "/keep/").otherwise("/in/"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    tier = F.when(F.col("o_orderkey") % 3 == 0, "queue").when(F.col("o_orderkey") % 3 == 1, "archive_candidate").otherwise("review")
    return layout.move_summary(layout.moves(o.select(path.alias("path"), tier.alias("tier")), FOLDERS))


def _archive(spark, d):
    k = F.col("doc_id")
    lang = F.coalesce("lang", F.lit("none"))
    folder = F.when((F.col("lang") == "de") & (k % 50 == 0), F.upper("lang")).otherwise(lang)
    sha = F.sha2(k.cast("string"), 256)
    items = table(spark, d, "documents").select(
        k.alias("k"), F.concat("source", F.lit("/"), k.cast("string"), F.lit(".png")).alias("src"),
        F.concat(F.lit("out/"), folder, F.lit("/"), (k % 900).cast("string"), F.when(k % 41 == 0, "/nul.png").when(k % 43 == 0, ". ").when(k % 59 == 0, F.repeat(F.lit("y"), 260)).otherwise(".png")).alias("dst"),
        lang.alias("target"), sha.alias("sha"), F.col("n_chars").cast("long").alias("size"), F.when(k % 13 != 0, F.when(k % 17 == 0, "x").otherwise(sha)).alias("src_sha"), (k % 53 != 0).alias("writable"), (k % 47 != 0).alias("same_volume"), F.when(k % 19 == 0, F.when(k % 38 == 0, "x").otherwise(sha)).alias("dst_sha"),
    )
    return layout.resolve(layout.classify(items), 1 << 40)


def archive_plan(spark, d):
    return _archive(spark, d).select("k", "src", "dst", F.array_join("conflicts", "|").alias("conflicts"))


def archive_totals(spark, d):
    return layout.archive_summary(_archive(spark, d))


def overlay_boxes(spark, d):
    k = F.col("p_partkey").cast("double")
    rect = lambda a, b, c, e: F.struct(a.alias("left"), b.alias("top"), c.alias("width"), e.alias("height"))
    box = rect(k % 97, k % 89, k % 31, k % 29 + 1)
    at = displayed_rect(box, F.lit(640.0), F.lit(480.0), rect(F.lit(10.0), F.lit(20.0), F.lit(320.0), F.lit(240.0)), F.struct(F.lit(4.0).alias("left"), F.lit(5.0).alias("top")), F.col("p_partkey") % 2 == 0)
    return table(spark, d, "part").select("p_partkey", at.alias("r")).select("p_partkey", *(F.round(f"r.{c}", 6).alias(c) for c in ("left", "top", "width", "height")))


def box_suppression(spark, d):
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.lit(100).alias("width"), F.lit(80).alias("height"), (x - 0.5).alias("x1"), (y - 0.5).alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + 20.25).alias("y2"), (F.col("l_extendedprice") / 100000).cast("double").alias("score"))
    return ordered.suppress(b.select("image", "width", "height", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), "score"), 0.4, 5)


QUERIES = {f.__name__: f for f in (greedy_representatives, representative_wall, label_whispers, seeded_sample, tag_projection, cluster_report, move_targets, archive_plan, archive_totals, overlay_boxes, box_suppression)}
#: Order-dependent beyond SQL; tests hold them against plain passes.
WITHOUT_SQL = {"representative_wall", "label_whispers", "seeded_sample", "box_suppression"}

_ITEMS = """i AS (SELECT doc_id AS k, source || '/' || doc_id || '.png' AS src, coalesce(lang, 'none') AS target, n_chars AS size,
  'out/' || CASE WHEN lang = 'de' AND doc_id % 50 = 0 THEN 'DE' ELSE coalesce(lang, 'none') END || '/' || (doc_id % 900) || CASE WHEN doc_id % 41 = 0 THEN '/nul.png' WHEN doc_id % 43 = 0 THEN '. ' WHEN doc_id % 59 = 0 THEN repeat('y', 260) ELSE '.png' END AS dst FROM documents),
p AS (SELECT k, array_to_string(s[1:n], '/') AS p FROM (SELECT k, string_split(dst, '/') AS s, unnest(range(1, len(string_split(dst, '/')) + 1)) AS n FROM i)),
hz AS (SELECT DISTINCT k FROM p WHERE lower(p) IN (SELECT lower(p) FROM p GROUP BY lower(p) HAVING count(DISTINCT p) > 1)),
c AS (SELECT *, list_filter([CASE WHEN k IN (SELECT k FROM hz) THEN 'case_hazard' END, CASE WHEN k % 13 <> 0 AND k % 17 = 0 THEN 'changed_source' END, CASE WHEN k % 47 = 0 THEN 'cross_volume' END, CASE WHEN k % 38 = 0 THEN 'different_target' END,
  CASE WHEN k % 13 = 0 THEN 'missing' END, CASE WHEN k % 19 = 0 OR count(*) OVER (PARTITION BY lower(dst)) > 1 OR count(*) OVER (PARTITION BY lower(src)) > 1 THEN 'name_collision' END, CASE WHEN length(src) >= 260 OR length(dst) >= 260 THEN 'path_length' END,
  CASE WHEN k % 13 <> 0 AND k % 53 = 0 THEN 'unreadable' END, CASE WHEN k % 41 = 0 OR k % 43 = 0 AND k % 41 <> 0 THEN 'unsafe_path' END], lambda x: x IS NOT NULL) AS conflicts FROM i)"""
_CONFLICTS = ", ".join(f"('{c}')" for c in layout.CONFLICTS)
ORACLE = {
    "greedy_representatives": f"WITH RECURSIVE {_V}, h AS (SELECT k, list_transform(v, lambda x: x > 0) AS h, row_number() OVER (ORDER BY k) AS n FROM v), e AS MATERIALIZED (SELECT a.n AS a, c.n AS b FROM h a JOIN h c ON a.n < c.n WHERE len(list_filter(list_zip(a.h, c.h), lambda p: p[1] <> p[2])) <= 15), m AS MATERIALIZED (SELECT n, k, (SELECT list(a) FROM e WHERE b = n) AS near FROM h), r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT m.n, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN kept ELSE list_append(kept, m.n) END FROM r JOIN m ON m.n = r.n + 1) SELECT k FROM m WHERE n IN (SELECT unnest(kept) FROM r WHERE n = (SELECT count(*) FROM h))",
    "tag_projection": "WITH t AS (SELECT l_suppkey AS k, l_returnflag AS category, CAST(l_partkey AS VARCHAR) AS name, max(round(l_quantity / 50, 4)) AS score FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY k, category ORDER BY score DESC, name) AS rank FROM t WHERE score > 0.35) SELECT * FROM r WHERE rank <= CASE category WHEN 'A' THEN 5 WHEN 'N' THEN 40 ELSE 0 END",
    "cluster_report": f"WITH {_V}, e AS (SELECT k, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), s AS (SELECT label, i, sum(x) AS t FROM e GROUP BY label, i), l AS (SELECT label, sqrt(sum(t * t)) AS len FROM s GROUP BY label), c AS (SELECT s.label, i, t / len AS c FROM s JOIN l ON l.label = s.label), n AS (SELECT e.k, e.label, sum(x * c) AS s FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY e.k, e.label), t AS (SELECT label, k, row_number() OVER (PARTITION BY label ORDER BY s DESC, k) AS rn FROM n), sh AS (SELECT label, string_agg(CAST(k AS VARCHAR), '|' ORDER BY rn) AS representatives FROM t WHERE rn <= 3 GROUP BY label), cc AS (SELECT a.label, b.label AS o, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2), mg AS (SELECT label, greatest(-1, least(1, max(s))) AS margin FROM cc GROUP BY label), g AS (SELECT label, min(k) AS least, count(*) AS size, avg((k % 10) / 10) AS confidence FROM v GROUP BY label) SELECT row_number() OVER (ORDER BY least) - 1 AS cluster_id, g.label AS cluster, size, round(confidence, 6) AS confidence, representatives, round(margin, 6) AS margin FROM g JOIN sh ON sh.label = g.label LEFT JOIN mg ON mg.label = g.label",
    "move_targets": "WITH m AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'keep' ELSE 'in' END AS folder, CASE o_orderkey % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'archive' END AS target FROM orders) SELECT target, count(*) AS n, count(*) FILTER (target <> folder) AS to_move, count(*) FILTER (target = folder) AS in_place FROM m GROUP BY target",
    "archive_plan": f"WITH {_ITEMS} SELECT k, src, dst, array_to_string(conflicts, '|') AS conflicts FROM c",
    "archive_totals": f"WITH {_ITEMS}, own AS (SELECT size FROM c WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 47 <> 0 AND k % 19 <> 0 AND k % 53 <> 0 AND k % 41 <> 0 AND k % 43 <> 0 AND length(dst) < 260), u AS (SELECT unnest(conflicts) AS name FROM c) SELECT 'target' AS kind, target AS name, count(*) AS n FROM c GROUP BY target UNION ALL SELECT 'conflict', x.name, count(u.name) FROM (VALUES {_CONFLICTS}) x(name) LEFT JOIN u ON u.name = x.name GROUP BY x.name UNION ALL SELECT 'total', 'ready', count(*) FILTER (len(conflicts) = 0) FROM c UNION ALL SELECT 'total', 'required_bytes', CAST(coalesce(sum(size), 0) AS BIGINT) FROM own",
    "overlay_boxes": "WITH b AS (SELECT p_partkey, p_partkey % 2 = 0 AS turned, p_partkey % 97 AS l, p_partkey % 89 AS t, p_partkey % 31 AS w, p_partkey % 29 + 1 AS h FROM part) SELECT p_partkey, CASE WHEN w > 0 THEN round(6 + CASE WHEN turned THEN (480 - t - h) * 320 / 480 ELSE l / 2 END, 6) END AS left, CASE WHEN w > 0 THEN round(15 + CASE WHEN turned THEN l * 240 / 640 ELSE t / 2 END, 6) END AS top, CASE WHEN w > 0 THEN round(CASE WHEN turned THEN h * 320 / 480 ELSE w / 2 END, 6) END AS width, CASE WHEN w > 0 THEN round(CASE WHEN turned THEN w * 240 / 640 ELSE h / 2 END, 6) END AS height FROM b",
}
