"""Queries of event-sourced state and of curated names, folders and review order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curation
from ..sources.tables import table
from ..streaming import store

#: The batch that is taken back.
BATCH = "4"


def _changes(spark, d):
    """97 keys, one revision for each change of all of them; odd keys stop after the sixth, some changes remove their key."""
    e = table(spark, d, "events").select(F.col("event_id").alias("position"), F.col("event_type").alias("t"))
    e = e.withColumn("key", F.col("position") % 97).withColumn("revision", F.floor(F.col("position") / 97)).filter("revision <= 5 OR key % 2 = 0")
    e = e.withColumn("after", F.when(F.col("position") % 13 != 0, F.col("t")))
    w = Window.partitionBy("key").orderBy("revision", "position")
    return e.select("key", F.col("revision").cast("string").alias("batch"), F.lit(None).cast("string").alias("inverse_of"), "revision", "position", F.lag("after").over(w).alias("before"), "after", F.lag("position").over(w).alias("before_token"), F.col("position").alias("after_token"))


def event_snapshot(spark, d):
    return store.snapshot(_changes(spark, d), 5)


def undo_plan(spark, d):
    return store.undo_plan(_changes(spark, d), BATCH)


def replay_breaks(spark, d):
    c = _changes(spark, d)
    stored = store.snapshot(c).filter("key % 17 <> 0").withColumn("after", F.when(F.col("key") % 19 == 0, "other").otherwise(F.col("after")))
    broken = c.withColumn("before_token", F.when(F.col("position") % 101 == 100, -1).otherwise(F.col("before_token")))
    return store.replay_breaks(broken, stored)


def _requests(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("paths"), F.min("l_returnflag").alias("action"))
    return g.select("l_orderkey", "action", (F.col("l_orderkey") % 7).alias("revision"), F.lit("profile-v1").alias("profile"), "paths")


def _receipts(spark, d):
    """Two receipts of each request: the first failed, the second is by its order."""
    r = _requests(spark, d)
    op = F.sha2(F.concat_ws("\n", "action", F.col("revision").cast("string"), "profile", F.array_join(F.array_sort("paths"), "\n")), 256)
    r = r.select(op.alias("operation"), "action", "l_orderkey")
    k = F.col("l_orderkey")
    second = F.when(k % 3 == 0, "failed").when(k % 5 == 0, "unavailable").when(k % 4 == 0, "cached").otherwise("completed")
    return r.select("operation", "action", (k * 2).alias("seq"), F.lit("failed").alias("outcome")).union(r.select("operation", "action", k * 2 + 1, second))


def action_status(spark, d):
    return store.actions(_requests(spark, d), _receipts(spark, d).filter("seq % 11 <> 0"))


def action_progress(spark, d):
    return store.progress(_receipts(spark, d))


def _steps(spark, d):
    e = table(spark, d, "events")
    a = F.element_at(F.array(*(F.lit(x) for x in ("prepare", "confirm", "dismiss", "retract", "confirm"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select((F.col("event_id") % 23).alias("root"), (F.col("event_id") % 207).alias("report"), F.col("event_id").alias("seq"), a.alias("action"))


def consent_states(spark, d):
    return store.consents(_steps(spark, d))


def outstanding_moves(spark, d):
    e = table(spark, d, "events")
    s = F.when(F.col("event_id") % 4 == 0, "undone").when(F.col("event_id") % 9 == 0, "already_undone").otherwise(F.col("event_type"))
    return store.outstanding(e.select((F.col("event_id") % 311).alias("item"), F.col("event_id").alias("seq"), s.alias("status")))


def _files(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("in/"), k, F.lit(".x.jpg")).alias("src"), F.concat(F.lit("out.d/"), k, F.when(k % 2 == 0, ".jpg").otherwise("")).alias("dst"), F.sha2(k.cast("string"), 256).alias("sha"))
    stem, tail = F.regexp_replace("dst", r"\.jpg$", ""), F.when(F.col("k") % 2 == 0, ".jpg").otherwise("")
    here = p.filter("k % 3 <> 0").select(F.col("src").alias("path"), F.when(F.col("k") % 10 == 0, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha"))
    there = p.filter("k % 4 = 1").select(F.col("dst").alias("path"), "sha").union(p.filter("k % 6 = 0").select(F.concat(stem, F.lit("__"), F.substring("sha", 1, 16), tail), "sha"))
    return p, here.union(there)


def move_recovery(spark, d):
    plan, files = _files(spark, d)
    return store.move_states(plan.select("src", F.when(F.col("k") % 31 != 0, F.col("dst")).alias("dst"), "sha"), plan.filter("k % 29 = 0").select("src"), files)


def _memory(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("name"), F.array("r_name", F.concat(F.lit("x"), F.col("n_nationkey"))).alias("aliases"), F.array(F.col("n_nationkey"), F.col("n_nationkey") % 4).alias("faces"))


def _decisions(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    own = s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(k % 3 == 0, F.concat(F.lit("x"), "n_nationkey")).when(k % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("new"), k % 7))
    tag = F.when(k % 4 == 0, F.concat(F.lit("x"), "n_nationkey")).otherwise(F.concat(F.lit("tag"), k % 6))
    d2 = own.select(name.alias("name"), tag.alias("tag"), k.alias("k"))
    return d2.groupBy("name", "tag").agg(F.min("k").alias("k")).select("name", "tag", F.when(F.col("k") % 2 == 0, "rejected").otherwise("confirmed").alias("decision"), "k")


def alias_decisions(spark, d):
    # names whose alias is shared have no single owner
    r = curation.decide_aliases(_memory(spark, d), _decisions(spark, d).filter("name NOT LIKE 'x%'").select("name", "tag", "decision"))
    return r.select("name", F.array_join("aliases", "|").alias("aliases"))


def alias_faults(spark, d):
    dec = _decisions(spark, d)
    twice = dec.select("name", "tag", "decision").union(dec.filter("k % 5 = 0").select("name", "tag", "decision"))
    return curation.alias_faults(_memory(spark, d), dec.filter("k % 7 <> 0"), twice)


def merged_names(spark, d):
    m = _memory(spark, d)
    moves = m.filter("n_nationkey % 5 = 1").select("name", F.col("n_nationkey").alias("i")).join(m.select(F.col("name").alias("target"), (F.col("n_nationkey") + 1).alias("i")), "i").drop("i")
    r = curation.merge_names(m, moves)
    return r.select("name", F.array_join("aliases", "|").alias("aliases"), F.array_join("faces", "|").alias("faces"))


def inherited_folders(spark, d):
    p = table(spark, d, "documents").select(F.concat_ws("/", "source", F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")).alias("path"))
    top = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("source").alias("folder")).distinct().withColumn("descendants", F.col("folder").like("%1"))
    low = table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").select(F.concat_ws("/", "source", "lang").alias("folder"), F.lit(False).alias("descendants")).distinct()
    return curation.inherited(p, top.union(low)).groupBy("folder").agg(F.count("*").alias("n"), F.min("path").alias("path"))


def deferred_tray(spark, d):
    li = table(spark, d, "lineitem")
    s = F.when(F.col("l_linenumber") == 6, "deferred").otherwise(F.col("l_returnflag"))
    g = li.groupBy("l_orderkey").agg(F.collect_set(s).alias("subjects"))
    o = table(spark, d, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return curation.deferred(o.select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderkey") % 8 == 0, "deferred").alias("disposition"), "subjects")).select("image")


def review_queue(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("k"), F.when(k % 5 != 0, k % 101 / 90).alias("p"), F.when(k % 7 != 0, k % 61 / 50 - 0.5).alias("m"), F.when(k % 6 != 0, k % 4).alias("size"), F.when(k % 11 != 0, k % 83 / 80).alias("s"))
    return p.select("k", F.round(curation.uncertainty(F.col("p"), F.col("m"), F.col("size"), F.col("s")), 6).alias("score"))


def review_clusters(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    declared = c.filter("c_custkey <= 60").select(k.alias("cluster"), (k % 9).alias("size"), F.when(k % 3 != 0, k / 100).alias("confidence"))
    faces = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey") % 90).alias("cluster"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 50 / 50).alias("probability"))
    return curation.effective_clusters(declared, faces).withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (event_snapshot, undo_plan, replay_breaks, action_status, action_progress, consent_states, outstanding_moves, move_recovery, alias_decisions, alias_faults, merged_names, inherited_folders, deferred_tray, review_queue, review_clusters)}

_CHANGES = """e AS (SELECT event_id AS position, event_id % 97 AS key, event_id // 97 AS revision, CASE WHEN event_id % 13 <> 0 THEN event_type END AS after FROM events),
c AS (SELECT *, lag(after) OVER w AS before, lag(position) OVER w AS before_token FROM e WHERE revision <= 5 OR key % 2 = 0 WINDOW w AS (PARTITION BY key ORDER BY position)),
last AS (SELECT key, max(position) AS token, arg_max({after: after}, position).after AS after FROM c GROUP BY key)"""
_OPS = r"""q AS (SELECT l_orderkey AS k, min(l_returnflag) AS action, sha256(min(l_returnflag) || chr(10) || l_orderkey % 7 || chr(10) || 'profile-v1' || chr(10) || string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY CAST(l_partkey AS VARCHAR))) AS operation FROM lineitem GROUP BY l_orderkey),
r AS (SELECT operation, action, k * 2 AS seq, 'failed' AS outcome FROM q UNION ALL SELECT operation, action, k * 2 + 1, CASE WHEN k % 3 = 0 THEN 'failed' WHEN k % 5 = 0 THEN 'unavailable' WHEN k % 4 = 0 THEN 'cached' ELSE 'completed' END FROM q)"""
_NAMES = "m AS (SELECT n_nationkey AS i, n_name AS name, [r_name, 'x' || n_nationkey] AS aliases, [n_nationkey, n_nationkey % 4] AS faces FROM nation JOIN region ON r_regionkey = n_regionkey)"
_DECISIONS = """b AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'x' || n_nationkey WHEN 1 THEN n_name ELSE 'new' || s_suppkey % 7 END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'x' || n_nationkey ELSE 'tag' || s_suppkey % 6 END AS tag FROM supplier JOIN nation ON n_nationkey = s_nationkey),
d AS (SELECT name, tag, min(k) AS k, CASE WHEN min(k) % 2 = 0 THEN 'rejected' ELSE 'confirmed' END AS decision FROM b GROUP BY name, tag)"""

ORACLE = {
    "event_snapshot": f"WITH {_CHANGES}, s AS (SELECT key, max(position) AS token FROM c WHERE revision <= 5 GROUP BY key) SELECT s.key, after, token FROM s JOIN c ON position = token WHERE after IS NOT NULL",
    "undo_plan": f"WITH {_CHANGES} SELECT c.key, CASE WHEN position = token THEN before END AS after, CASE WHEN position = token THEN 'undo' ELSE 'conflict' END AS status FROM c JOIN last ON last.key = c.key WHERE revision = {BATCH}",
    "replay_breaks": f"WITH {_CHANGES} SELECT key, revision, 'token' AS kind FROM c WHERE position % 101 = 100 UNION ALL SELECT key, CAST(NULL AS BIGINT), CASE WHEN key % 17 = 0 THEN 'missing' ELSE 'different' END FROM last WHERE after IS NOT NULL AND (key % 17 = 0 OR key % 19 = 0)",
    "action_status": f"WITH {_OPS}, l AS (SELECT operation, arg_max(outcome, seq) AS outcome FROM r WHERE seq % 11 <> 0 GROUP BY operation) SELECT q.operation, action, CASE WHEN outcome = 'completed' THEN 'cached' ELSE 'execute' END AS status FROM q LEFT JOIN l ON l.operation = q.operation",
    "action_progress": f"WITH {_OPS}, l AS (SELECT operation, arg_max(outcome, seq) AS o, arg_max(action, seq) AS action FROM r GROUP BY operation) SELECT action, count(*) FILTER (o = 'completed') AS completed, count(*) FILTER (o = 'cached') AS cached, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'unavailable') AS unavailable FROM l GROUP BY action",
    "consent_states": "WITH s AS (SELECT event_id % 23 AS root, event_id % 207 AS report, event_id AS seq, ['prepare', 'confirm', 'dismiss', 'retract', 'confirm'][event_id % 5 + 1] AS action FROM events), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY root, report ORDER BY seq DESC) = 1) SELECT root, report, CASE WHEN action = 'confirm' AND seq < max(seq) FILTER (action = 'confirm') OVER (PARTITION BY root) THEN 'superseded' ELSE action END AS status FROM l",
    "outstanding_moves": "SELECT item, status FROM (SELECT event_id % 311 AS item, event_id, CASE WHEN event_id % 4 = 0 THEN 'undone' WHEN event_id % 9 = 0 THEN 'already_undone' ELSE event_type END AS status FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 311 ORDER BY event_id DESC) = 1) WHERE status NOT IN ('undone', 'already_undone')",
    "move_recovery": """WITH p AS (SELECT p_partkey AS k, 'in/' || p_partkey || '.x.jpg' AS src, 'out.d/' || p_partkey AS stem, CASE WHEN p_partkey % 2 = 0 THEN '.jpg' ELSE '' END AS tail, sha256(CAST(p_partkey AS VARCHAR)) AS sha FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 29 <> 0),
      f AS (SELECT k, src, CASE WHEN k % 4 = 1 THEN stem || tail WHEN k % 6 = 0 THEN stem || '__' || substr(sha, 1, 16) || tail END AS found, k % 3 <> 0 AS here FROM p)
      SELECT src, found, CASE WHEN here AND k % 10 = 0 THEN 'conflict' WHEN found IS NULL THEN CASE WHEN here THEN 'source_only' ELSE 'lost' END WHEN here THEN 'both' ELSE 'moved' END AS state FROM f""",
    "alias_decisions": f"WITH {_NAMES}, {_DECISIONS}, u AS (SELECT name, unnest(aliases) AS tag FROM m UNION SELECT name, tag FROM d WHERE decision = 'confirmed' AND name NOT LIKE 'x%'), v AS (SELECT DISTINCT u.name, u.tag FROM u ANTI JOIN (SELECT name, tag FROM d WHERE decision = 'rejected' AND name NOT LIKE 'x%') z ON z.name = u.name AND z.tag = u.tag), n AS (SELECT name FROM m UNION SELECT name FROM d WHERE name NOT LIKE 'x%') SELECT n.name, coalesce(string_agg(tag, '|' ORDER BY tag) FILTER (tag <> n.name), '') AS aliases FROM n LEFT JOIN v ON v.name = n.name GROUP BY n.name",
    "alias_faults": f"WITH {_NAMES}, {_DECISIONS}, w AS (SELECT name AS owner, name FROM m UNION SELECT name, unnest(aliases) FROM m) SELECT d.name, tag, CASE WHEN k % 5 = 0 THEN 'twice' WHEN k % 7 = 0 THEN 'unobserved' ELSE 'own_name' END AS fault FROM d LEFT JOIN w ON w.name = d.name WHERE k % 5 = 0 OR k % 7 = 0 OR (decision = 'rejected' AND tag = coalesce(owner, d.name))",
    "merged_names": f"WITH {_NAMES}, t AS (SELECT m.*, coalesce(o.name, m.name) AS owner FROM m LEFT JOIN m o ON m.i % 5 = 1 AND o.i = m.i - 1), a AS (SELECT owner, name AS x FROM t UNION SELECT owner, unnest(aliases) FROM t), f AS (SELECT DISTINCT owner, unnest(faces) AS x FROM t) SELECT a.owner AS name, string_agg(a.x, '|' ORDER BY a.x) FILTER (a.x <> a.owner) AS aliases, (SELECT string_agg(CAST(x AS VARCHAR), '|' ORDER BY x) FROM f WHERE f.owner = a.owner) AS faces FROM a GROUP BY a.owner",
    "inherited_folders": "WITH p AS (SELECT concat_ws('/', source, coalesce(lang, 'none'), CAST(doc_id AS VARCHAR)) AS path FROM documents), f AS (SELECT DISTINCT source AS folder, ends_with(source, '1') AS below FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT source || '/' || lang, false FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT folder, count(*) AS n, min(path) AS path FROM p JOIN f ON starts_with(path, folder || '/') AND (below OR NOT contains(substr(path, length(folder) + 2), '/')) GROUP BY folder",
    "deferred_tray": "SELECT o_orderkey AS image FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6)",
    "review_queue": "WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 101 / 90 END AS p, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 61 / 50 - 0.5 END AS m, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 4 END AS size, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 83 / 80 END AS s FROM part) SELECT k, round(CASE WHEN p IS NULL THEN 0.55 ELSE 1 - least(p, 1) END * 0.4 + CASE WHEN m IS NULL THEN 0.5 ELSE 1 - least(1, abs(m) / 0.5) END * 0.3 + CASE WHEN size IS NULL OR size <= 1 THEN 0.2 ELSE 0 END + CASE WHEN s IS NULL THEN 0.5 ELSE 1 - least(s, 1) END * 0.1, 6) AS score FROM p",
    "review_clusters": "WITH c AS (SELECT c_custkey AS cluster, c_custkey % 9 AS size, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey / 100 END AS confidence FROM customer WHERE c_custkey <= 60), g AS (SELECT o_custkey % 90 AS cluster, count(*) AS n, avg(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 50 / 50 END) AS mean FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1) SELECT coalesce(c.cluster, g.cluster) AS cluster, coalesce(c.size, g.n) AS size, round(coalesce(confidence, mean), 6) AS confidence FROM c FULL JOIN g ON g.cluster = c.cluster",
}
