"""Queries of inventory, review, events, sets, folders and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ancestors, natural_key
from ..operators import inventory
from ..operators.skew import kept_folder, placed
from ..sources.ledger import Ledger
from ..sources.tables import table
from ..streaming import events as ev


def _revisions(spark, d):
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "doc_id")
    old = docs.filter("doc_id % 7 <> 0").select("path", "sha")
    new = docs.filter("doc_id % 11 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("sha", F.lit("x")), 256)).otherwise(F.col("sha")).alias("sha"))
    return old, new


def inventory_delta(spark, d):
    return inventory.delta(*_revisions(spark, d))


def duplicate_marks(spark, d):
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return inventory.duplicates(docs)


def new_content(spark, d):
    old, new = _revisions(spark, d)
    return new.join(old.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.count("*").alias("n"), F.min("path").alias("path"))


def review_filter(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    hit = F.lower(F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string"))).contains("src1")
    return docs.filter(hit & (F.col("lang") == "en") & F.col("quality").isNull()).select("doc_id", "source").orderBy(F.desc_nulls_last("source"), "doc_id")


def nulls_last_sort(spark, d):
    """Every document's place in both directions; what has no value comes last in either."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")
    down = placed(docs, F.desc_nulls_last("quality"), F.col("doc_id"), name="down")
    up = placed(docs, F.asc_nulls_last("quality"), F.col("doc_id"), name="up").select("doc_id", "up")
    return down.join(up, "doc_id").select("doc_id", "quality", (F.col("down") + 1).alias("place"), (F.col("up") + 1).alias("place_up"))


def natural_sort(spark, d):
    """Every page's place by its url, runs of digits compared as numbers."""
    p = table(spark, d, "pages").select("page_id", natural_key(F.col("url")).alias("key"))
    return placed(p, F.asc_nulls_last("key"), F.col("page_id")).select("page_id", (F.col("place") + 1).alias("place"))


def neighbour_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 5)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 6).alias("mean"))


def latest_event(spark, d):
    return ev.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


def naming_fold(spark, d):
    e = table(spark, d, "events")
    a = F.element_at(F.array(*(F.lit(x) for x in ("confirm", "new", "ignore", "wrong_box"))), (F.col("event_id") % 4 + 1).cast("int"))
    return ev.naming_fold(e.select((F.col("event_id") % 97).alias("k"), F.col("event_id").alias("seq"), a.alias("action"), F.col("event_type").alias("name")))


def undo_fold(spark, d):
    e = table(spark, d, "events")
    return ev.undone(e.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "undo").otherwise(F.col("event_type")).alias("action")))


def silent_gaps(spark, d):
    return ev.gaps(table(spark, d, "events").withColumn("seq", F.col("event_id")), "user_id", "ts", 3600).select("event_id", "user_id", F.col("gap").cast("long").alias("gap"))


def chain_breaks(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("seq"), F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256).alias("digest"))
    prev = F.when(F.col("seq") == 1, "").when((F.col("conv_id") + F.col("seq")) % 17 == 0, "broken").otherwise(F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), (F.col("seq") - 2).cast("string")), 256))
    return ev.chain_breaks(c.withColumn("previous", prev), "conv_id", "seq", "digest", "previous").select("conv_id", "seq")


def event_ledger(spark, d):
    """Events as a chained log, written and read back: each segment's digests, and what its verification finds."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("|", "event_id", "user_id", "event_type").alias("line"))
    log = Ledger(spark, kept_folder(spark, "ledger"), 500)
    log.append(e, "line", "event_id")
    tails = log.records().groupBy("segment").agg(F.max_by("digest", "sequence").alias("tail"), F.count("*").alias("records"), F.min("sequence").alias("first"))
    heads = spark.createDataFrame([(h["number"], h["head"]) for h in log.heads()], "segment long, head string")
    return tails.join(heads, "segment").join(log.faults().groupBy("segment").agg(F.count("*").alias("faults")), "segment", "left").na.fill(0, ["faults"])


def folder_tree(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), "page_id")
    return p.select("page_id", F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("pages"))


def folder_purity(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    g = n.groupBy("source").agg(F.sum("n").alias("total"), F.max_by("lang", F.struct("n", "lang")).alias("modal"), F.max("n").alias("most"))
    return g.select("source", "total", "modal", F.round(F.col("most") / F.col("total"), 6).alias("purity"))


def attribute_shares(spark, d):
    w = Window.partitionBy("user_id")
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.select("user_id", "event_type", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


def support_quantiles(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("best"))
    return g.groupBy("l_suppkey").agg(F.count("*").alias("parts"), F.min("best").alias("low"), *(F.round(F.percentile("best", F.lit(p)), 6).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))), F.max("best").alias("high"))


def alias_lookup(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").filter("r_regionkey < 3")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.select("n_nationkey", F.coalesce("r_name", "n_name").alias("canonical"))


def assignment_diff(spark, d):
    c = table(spark, d, "customer")
    a = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("before"))
    b = c.filter("c_custkey % 4 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("after"))
    return inventory.changed(a, b, "c_custkey")


def merged_options(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").alias("model"))
    b = p.filter("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") * 2).alias("memory"))
    return a.join(b, "p_partkey", "full").select("p_partkey", "model", "memory", F.when(F.col("model").isNotNull(), "model").otherwise("memory").alias("source"))


def conflicting_references(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("crop"), F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return inventory.effective(r)


def cluster_lineage(spark, d):
    m = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("old"), (F.col("c_custkey") % 7 * 100 + F.col("c_nationkey") % 5).alias("new"))
    return inventory.lineage(m.select("c_custkey", "old"), m.select("c_custkey", "new"), "c_custkey")


def set_operations(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select("c_custkey")
    both, only = o.intersect(c), c.exceptAll(o.distinct())
    return both.agg(F.lit("both").alias("kind"), F.count("*").alias("n")).union(only.agg(F.lit("without").alias("kind"), F.count("*").alias("n"))).union(o.union(c).distinct().agg(F.lit("any").alias("kind"), F.count("*").alias("n")))


def integrity_violations(spark, d):
    li = table(spark, d, "lineitem")
    rules = {"quantity_range": F.col("l_quantity").between(1, 40), "discount_range": F.col("l_discount").between(0, 0.09), "flag_known": F.col("l_returnflag").isin("A", "N")}
    return inventory.violations(li, rules)


def source_concentration(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return g.groupBy("l_partkey").agg(F.sum("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


def adjusted_rand(spark, d):
    return inventory.adjusted_rand(table(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), (F.col("c_custkey") % 5).alias("b"))).select(F.round("ari", 6).alias("ari"))


def corpus_fingerprint(spark, d):
    docs = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("s"), "source")
    return docs.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("s")), "\n"), 256).alias("fingerprint"))


def whole_fingerprint(spark, d):
    """The digest of all distinct contents in order, however many there are."""
    docs = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("s"))
    return spark.createDataFrame([inventory.fingerprint(docs, "s")], "contents long, fingerprint string")


def price_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


QUERIES = {f.__name__: f for f in (inventory_delta, duplicate_marks, new_content, review_filter, nulls_last_sort, natural_sort, neighbour_frame, latest_event, naming_fold, undo_fold, silent_gaps, chain_breaks, event_ledger, folder_tree, folder_purity, attribute_shares, support_quantiles, alias_lookup, assignment_diff, merged_options, conflicting_references, cluster_lineage, set_operations, integrity_violations, source_concentration, adjusted_rand, corpus_fingerprint, whole_fingerprint, price_rollup)}
_REV = "docs AS (SELECT source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS sha, doc_id FROM documents), o AS (SELECT path, sha FROM docs WHERE doc_id % 7 <> 0), n AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256(sha || 'x') ELSE sha END AS sha FROM docs WHERE doc_id % 11 <> 0)"
ORACLE = {
    "inventory_delta": f"WITH {_REV} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.sha <> n.sha THEN 'changed' ELSE 'same' END AS status FROM o FULL JOIN n ON n.path = o.path",
    "duplicate_marks": "SELECT path, sha, row_number() OVER (PARTITION BY sha ORDER BY path) > 1 AS duplicate FROM (SELECT source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS sha FROM documents)",
    "new_content": f"WITH {_REV} SELECT sha, count(*) AS n, min(path) AS path FROM n WHERE sha NOT IN (SELECT sha FROM o) GROUP BY sha",
    "review_filter": "SELECT d.doc_id, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE contains(lower(concat_ws(' ', source, lang, CAST(d.doc_id AS VARCHAR))), 'src1') AND lang = 'en' AND quality IS NULL",
    "nulls_last_sort": "SELECT d.doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, d.doc_id) AS place, row_number() OVER (ORDER BY quality NULLS LAST, d.doc_id) AS place_up FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "natural_sort": r"WITH k AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS k FROM pages) SELECT page_id, row_number() OVER (ORDER BY k NULLS LAST, page_id) AS place FROM k",
    "whole_fingerprint": "SELECT count(DISTINCT s) AS contents, sha256(string_agg(DISTINCT s, chr(10) ORDER BY s)) AS fingerprint FROM (SELECT sha256(coalesce(text, '')) AS s FROM documents)",
    "neighbour_frame": "SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)",
    "latest_event": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "naming_fold": "SELECT k, CASE WHEN a < 2 THEN event_type END AS name, a >= 2 AS excluded FROM (SELECT event_id % 97 AS k, event_id % 4 AS a, event_type, row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "undo_fold": "WITH e AS (SELECT user_id AS k, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'undo' ELSE event_type END AS action FROM events), s AS (SELECT *, sum(CASE WHEN action = 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY k ORDER BY seq DESC) AS b FROM e), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s) SELECT k, arg_max(action, seq) AS action, max(seq) AS seq FROM m WHERE action <> 'undo' AND b > greatest(coalesce(h, 0), 0) GROUP BY k",
    "silent_gaps": "SELECT event_id, user_id, gap FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events) WHERE gap > 3600",
    "chain_breaks": "WITH c AS (SELECT conv_id, turn + 1 AS seq, sha256(conv_id || '|' || turn) AS digest, CASE WHEN turn = 0 THEN '' WHEN (conv_id + turn + 1) % 17 = 0 THEN 'broken' ELSE sha256(conv_id || '|' || (turn - 1)) END AS previous FROM conversations) SELECT conv_id, seq FROM (SELECT *, row_number() OVER w AS n, lag(digest, 1, '') OVER w AS p FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) WHERE n <> seq OR p <> previous",
    "event_ledger": """
WITH RECURSIVE e AS (
  SELECT concat_ws('|', event_id, user_id, event_type) AS line, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events),
r AS (SELECT pos // 500 AS segment, pos % 500 AS i, line FROM e),
c AS (
  SELECT segment, -1::BIGINT AS i, sha256('segment:' || segment) AS digest FROM (SELECT DISTINCT segment FROM r)
  UNION ALL SELECT r.segment, r.i, sha256(c.digest || chr(10) || r.line) FROM c JOIN r ON r.segment = c.segment AND r.i = c.i + 1),
t AS (SELECT segment, arg_max(digest, i) AS tail, count(*) - 1 AS records FROM c GROUP BY segment),
h AS (
  SELECT -1::BIGINT AS segment, '' AS head
  UNION ALL SELECT t.segment, sha256(h.head || chr(10) || t.tail || chr(10) || t.records) FROM h JOIN t ON t.segment = h.segment + 1)
SELECT t.segment, tail, records, t.segment * 500 + 1 AS first, head, 0::BIGINT AS faults FROM t JOIN h USING (segment)
""",
    "folder_tree": "WITH p AS (SELECT string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS s FROM pages), a AS (SELECT array_to_string(s[1:i], '/') AS folder FROM (SELECT s, unnest(range(1, len(s))) AS i FROM p)) SELECT folder, count(*) AS pages FROM a GROUP BY folder",
    "folder_purity": "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) SELECT source, CAST(sum(n) AS BIGINT) AS total, (list(lang ORDER BY n DESC, lang DESC))[1] AS modal, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY source",
    "attribute_shares": "SELECT user_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type",
    "support_quantiles": "WITH g AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, count(*) AS parts, min(best) AS low, round(quantile_cont(best, 0.25), 6) AS p25, round(quantile_cont(best, 0.5), 6) AS p50, round(quantile_cont(best, 0.75), 6) AS p75, max(best) AS high FROM g GROUP BY l_suppkey",
    "alias_lookup": "SELECT n_nationkey, coalesce(r_name, n_name) AS canonical FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3",
    "assignment_diff": "SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.s AS before, b.s AS after FROM (SELECT c_custkey, c_mktsegment AS s FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 4 <> 0) b ON a.c_custkey = b.c_custkey WHERE a.s IS DISTINCT FROM b.s",
    "merged_options": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS model, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 END AS memory, CASE WHEN p_partkey % 2 = 0 THEN 'model' ELSE 'memory' END AS source FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
    "conflicting_references": "SELECT l_orderkey AS crop, min(l_returnflag) AS label, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1",
    "cluster_lineage": "WITH m AS (SELECT DISTINCT c_nationkey AS old, c_custkey % 7 * 100 + c_nationkey % 5 AS new FROM customer), s AS (SELECT old, count(*) AS n FROM m GROUP BY old), p AS (SELECT new, count(*) AS n FROM m GROUP BY new) SELECT m.old, m.new, s.n > 1 AS split, p.n > 1 AS merged FROM m JOIN s ON s.old = m.old JOIN p ON p.new = m.new",
    "set_operations": "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'without', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'any', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)",
    "integrity_violations": "SELECT 'quantity_range' AS rule, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 40) AS n FROM lineitem UNION ALL SELECT 'discount_range', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.09) FROM lineitem UNION ALL SELECT 'flag_known', count(*) FILTER (NOT l_returnflag IN ('A', 'N')) FROM lineitem",
    "source_concentration": "WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS largest_share FROM g GROUP BY l_partkey",
    "adjusted_rand": "WITH c AS (SELECT c_mktsegment AS a, c_custkey % 5 AS b, count(*) AS n FROM customer GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS ij FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b)), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS s FROM c) SELECT round((ij - a.s * b.s / t.s) / ((a.s + b.s) / 2 - a.s * b.s / t.s), 6) AS ari FROM x, a, b, t",
    "corpus_fingerprint": "SELECT source, sha256(string_agg(DISTINCT s, chr(10) ORDER BY s)) AS fingerprint FROM (SELECT source, sha256(coalesce(text, '')) AS s FROM documents) GROUP BY source",
    "price_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
