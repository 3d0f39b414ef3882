"""Queries of codes and digests, folds of commands, and of the review page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import browser, reports
from ..sources.tables import TIERS, table
from ..streaming import memory
from .scoring import TIERED_SQL, _tiered

NOW = "2030-01-01 00:00:00"


def identifiers(spark, d):
    k = F.col("vec_id")
    sha = F.sha2(k.cast("string"), 256)
    box = F.array(k % 7, k % 11, k % 13 + 1, k % 17 + 1)
    return table(spark, d, "embeddings").select(
        "vec_id", codecs.face_id(sha, box).alias("face"), codecs.crop_path(codecs.face_id(sha, box)).alias("crop"), codecs.folder_id(F.concat(F.lit("a/"), k % 5)).alias("folder"), codecs.occurrence_id(F.concat(F.lit("a/"), k), sha).alias("occurrence"),
        codecs.cache_namespace(F.lit("model"), (k % 3).cast("string"), F.lit("rgb"), F.lit("none"), F.lit("cpu")).alias("namespace"),
    )


def vector_codec(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", codecs.floats_to_base64(F.col("embedding")).alias("t"))
    return v.select("vec_id", F.length("t").alias("length"), (codecs.base64_to_floats(F.col("t")) == F.col("embedding")).alias("same"))


def canonical_rows(spark, d):
    docs = table(spark, d, "documents")
    j = codecs.canonical_json(source=F.col("source"), lang=F.col("lang"), id=F.col("doc_id"), text=F.col("text"))
    return docs.select("doc_id", F.sha2(j, 256).alias("fingerprint"), F.length(codecs.ascii_json(F.regexp_replace("text", r"[^\x20-\x7Eäöüßéèç]", ""))).alias("ascii"), codecs.html_safe(F.to_json(F.struct(F.concat(F.lit("<a&"), "lang").alias("x")))).alias("safe"))


def budgets(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", codecs.decode_bytes(k * 1000, F.col("p_size"), k % 50).alias("decode"), codecs.host_budget(F.lit(20 << 20), k * 90_000, k * 70_000).alias("host"), codecs.device_budget(k * 1000, k * 900).alias("device"), codecs.shown(F.when(k % 9 != 0, k / 8)).alias("shown"), codecs.percent(k % 200, F.lit(200)).alias("percent"))


def cluster_snapshots(spark, d):
    e = table(spark, d, "embeddings")
    say = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    m = F.struct(say("i", F.col("vec_id")).alias("image"), F.when(F.col("vec_id") % 3 == 0, say("s", F.col("vec_id"))).alias("subject"), say("c", F.col("vec_id")).alias("crop"), F.lit("p1").alias("profile"))
    g = e.groupBy("label").agg(F.collect_list(m).alias("m"), F.collect_set(say("q", F.col("vec_id") % 3)).alias("q"))
    return g.select("label", codecs.cluster_snapshot_id(F.col("m"), F.col("q"), F.lit(None).cast("string")).alias("snapshot"))


def _named(spark, d):
    k = F.col("event_id")
    a = F.element_at(F.array(*(F.lit(x) for x in ("confirm", "new", "confirm", "ignore", "wrong_box"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "events").select((k % 331).alias("face"), k.alias("seq"), a.alias("action"), F.col("event_type").alias("character"), F.when(k % 4 == 0, "baseline").when(k % 7 == 0, "variant").alias("mark"))


def memory_fold(spark, d):
    return memory.memory_fold(_named(spark, d))


def attribute_profile(spark, d):
    hair = table(spark, d, "part").select(F.col("p_partkey").alias("face"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("h"), (F.col("p_partkey") % 3).cast("string"))).alias("value"))
    r = memory.attribute_profile(memory.memory_fold(_named(spark, d)), hair)
    return r.withColumn("share", F.round("share", 6))


def visual_support(spark, d):
    return memory.visual_support(memory.memory_fold(_named(spark, d))).select("character", F.array_join(F.transform("faces", lambda x: x.cast("string")), "|").alias("faces"))


def run_controls(spark, d):
    e = table(spark, d, "events")
    beats = e.select((F.col("event_id") % 50).alias("run"), F.when(F.col("event_id") % 50 < 30, F.col("ts")).otherwise(F.lit("2029-12-31 23:59:30").cast("timestamp")).alias("ts"))
    c = F.element_at(F.array(*(F.lit(x) for x in ("pause", "resume", "pause", "resume"))), (F.col("event_id") % 4 + 1).cast("int"))
    controls = e.filter("event_id % 3 = 0").select((F.col("event_id") % 50).alias("run"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 7, "cancel").when(F.col("event_id") % 50 == 9, "finish").otherwise(c).alias("control"))
    return memory.run_controls(beats, controls, NOW)


def sealed_receipts(spark, d):
    r = table(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("revision"), F.col("o_orderkey").alias("operation"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("completed").alias("outcome"))
    return memory.sealed_receipts(r, spark.range(0, 40, 3).select(F.col("id").alias("revision")))


def tray_fold(spark, d):
    k = F.col("event_id")
    a = F.element_at(F.array(*(F.lit(x) for x in ("archive", "reopen", "defer", "unknown-foreign", "notify", "notify", "defer"))), (k % 7 + 1).cast("int"))
    c = table(spark, d, "events").select((k * 5 % 900).alias("image"), k.alias("seq"), a.alias("action"), (k % 6).alias("trigger"))
    images = spark.range(900).select(F.col("id").alias("image"), (F.col("id") % 3).alias("subjects"), F.when(F.col("id") % 2 == 0, "pending").otherwise("assigned").alias("disposition"))
    return memory.tray_fold(c, images).withColumn("triggers", F.array_join(F.transform("triggers", lambda x: x.cast("string")), "|"))


def cache_states(spark, d):
    req = table(spark, d, "orders").select((F.col("o_orderkey") % 4000).alias("content"), (F.col("o_custkey") % 3).alias("namespace")).distinct()
    k = F.col("p_partkey")
    entries = table(spark, d, "part").select(k.alias("content"), (k % 3).alias("namespace"), k.cast("string").alias("payload"), F.when(k % 10 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("digest"))
    return memory.cache_states(req, entries)


def decoded_payload(spark, d):
    t = _tiered(spark, d).select("position", "proposed_tier", "flags")
    p = reports.columnar_payload(t, "position", ["position", "proposed_tier", "flags"], {"proposed_tier": list(TIERS)}, 500)
    return browser.decoded_payload(p, {"position": "bigint", "proposed_tier": "string", "flags": "string"}, {"proposed_tier": list(TIERS)})


def face_order(spark, d):
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), k.alias("face"), F.when(k % 5 == 0, k % 3).alias("shown"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("uncertainty"))
    return browser.face_order(f).join(browser.face_order(f, True).withColumnRenamed("place", "uncertain"), ["cluster", "face"])


def effective_labels(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    say = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    c = table(spark, d, "customer")
    return browser.effective_labels(
        o.select(k.alias("face"), F.col("o_custkey").alias("cluster")), o.filter(k % 7 == 0).select(k.alias("face"), say("j", k % 4).alias("label")), o.filter(k % 5 == 0).select(k.alias("face"), say("f", k % 4).alias("label")),
        c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("cluster"), say("c", F.col("c_custkey") % 4).alias("label")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cluster"), F.col("c_mktsegment").alias("label")),
    )


def candidate_sections(spark, d):
    s = F.element_at(F.array(*(F.lit(x) for x in ("model", "memory", "bucket", "other"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("face"), s.alias("source"), F.col("l_partkey").alias("name")).agg(F.min("l_linenumber").alias("rank"))
    r = browser.sections(c)
    return r.select("face", *(F.array_join(F.transform(x, lambda v: v.cast("string")), "|").alias(x) for x in ("model", "memory", "bucket")))


def draft_faults(spark, d):
    o = table(spark, d, "orders")
    members = o.select((F.col("o_custkey") % 60).alias("cluster"), F.col("o_orderkey").alias("member"), (F.col("o_orderkey") % 200).alias("image"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 60 % 4).alias("label"))
    split = members.filter("cluster < 20 AND (cluster % 4 = 0 OR member % 3 = 0)").select(F.col("cluster").alias("draft"), F.lit("split").alias("action"), (F.col("member") % 2).alias("part"), F.when(F.col("cluster") % 5 == 4, 59 - F.col("cluster")).otherwise(F.col("cluster")).alias("cluster"), "member")
    merge = spark.range(20, 40).select(F.col("id").alias("draft"), F.lit("merge").alias("action"), F.lit(0).cast("long").alias("part"), F.explode(F.when(F.col("id") % 6 == 0, F.array("id")).otherwise(F.array("id", F.col("id") + 20))).alias("cluster"), F.lit(None).cast("long").alias("member"))
    return browser.draft_faults(split.union(merge), members)


def restored_drafts(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    pairs = p.filter(k % 6 != 0).select(F.col("p_brand").alias("name"), k.alias("tag"), F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "rejected").alias("decision"))
    drafts = p.filter(k % 3 != 1).select(F.col("p_brand").alias("name"), k.alias("tag"), F.when(k % 8 == 0, "confirmed").when(k % 4 == 1, "rejected").alias("base"), F.lit("rejected").alias("draft"))
    return browser.restored_drafts(drafts, pairs)


def exported_decisions(spark, d):
    m = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("source").alias("folder"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("image"))
    scopes = table(spark, d, "documents").filter("source IS NOT NULL").select(F.coalesce("lang", F.lit("none")).alias("scope"), F.col("source").alias("folder")).distinct()
    return browser.exported_decisions(scopes.union(spark.createDataFrame([("none", "absent")], "scope string, folder string")), m, "r1")


def suggestion_tiers(spark, d):
    k = F.col("c_custkey")
    say = lambda p: F.concat(F.lit(p), k.cast("string"))
    return table(spark, d, "customer").select("c_custkey", browser.suggestion_tier(F.when(k % 5 == 0, say("v")), F.when(k % 3 != 0, say("m")), F.when(k % 4 != 0, k % 7 == 0), F.when(k % 6 != 1, say("s"))).alias("tier"))


QUERIES = {f.__name__: f for f in (identifiers, vector_codec, canonical_rows, budgets, cluster_snapshots, memory_fold, attribute_profile, visual_support, run_controls, sealed_receipts, tray_fold, cache_states, decoded_payload, face_order, effective_labels, candidate_sections, draft_faults, restored_drafts, exported_decisions, suggestion_tiers)}

_NAMED = """n AS (SELECT event_id % 331 AS face, event_id AS seq, CASE WHEN event_id % 5 < 3 THEN event_type END AS ch, CASE WHEN event_id % 4 = 0 THEN 'baseline' WHEN event_id % 7 = 0 THEN 'variant' END AS mark FROM events),
r AS (SELECT *, sum(CASE WHEN ch IS DISTINCT FROM p OR f THEN 1 ELSE 0 END) OVER (PARTITION BY face ORDER BY seq) AS run FROM (SELECT *, lag(ch) OVER w AS p, row_number() OVER w = 1 AS f FROM n WINDOW w AS (PARTITION BY face ORDER BY seq))),
mem AS (SELECT face, max(ch) AS character, arg_max(mark, seq) FILTER (mark IS NOT NULL) AS mark FROM r WHERE run = (SELECT max(run) FROM r z WHERE z.face = r.face) GROUP BY face HAVING max(ch) IS NOT NULL)"""
ORACLE = {
    "identifiers": """SELECT vec_id, 'f_' || substr(sha256(sha256(CAST(vec_id AS VARCHAR)) || '[' || vec_id % 7 || ',' || vec_id % 11 || ',' || (vec_id % 13 + 1) || ',' || (vec_id % 17 + 1) || ']'), 1, 8) AS face, 'faces/f_' || substr(sha256(sha256(CAST(vec_id AS VARCHAR)) || '[' || vec_id % 7 || ',' || vec_id % 11 || ',' || (vec_id % 13 + 1) || ',' || (vec_id % 17 + 1) || ']'), 1, 8) || '.jpg' AS crop, sha256('directory-v1:a/' || vec_id % 5) AS folder, sha256('occurrence-v1:a/' || vec_id || ':' || sha256(CAST(vec_id AS VARCHAR))) AS occurrence,
  sha256('["cache-v2", "' || sha256('model@' || vec_id % 3) || '", "' || sha256('rgb|none') || '", "outputs-v1", "cpu"]') AS namespace FROM embeddings""",
    "vector_codec": "SELECT vec_id, (len(embedding) * 4 + 2) // 3 * 4 AS length, true AS same FROM embeddings",
    "canonical_rows": r"""SELECT doc_id, sha256('{"id":' || doc_id || ',"lang":' || coalesce(to_json(lang), 'null') || ',"source":' || coalesce(to_json(source), 'null') || ',"text":' || coalesce(to_json(text), 'null') || '}') AS fingerprint, length(t) + 5 * length(regexp_replace(t, '[ -~]', '', 'g')) AS ascii, '{' || coalesce('"x":"\u003ca\u0026' || lang || '"', '') || '}' AS safe FROM (SELECT *, regexp_replace(text, '[^ -~äöüßéèç]', '', 'g') AS t FROM documents)""",
    "budgets": "SELECT p_partkey, 4 * p_partkey * 1000 + 48 * p_size * (p_partkey % 50) + 16777216 AS decode, CAST(floor(least(20971520, 0.65::DOUBLE * (p_partkey * 90000), 0.75::DOUBLE * (p_partkey * 70000))) AS BIGINT) AS host, CAST(floor(least(0.8::DOUBLE * (p_partkey * 1000), 0.85::DOUBLE * (p_partkey * 900))) AS BIGINT) AS device, CASE WHEN p_partkey % 9 <> 0 THEN printf('%.3f', round(p_partkey / 8, 3)) ELSE '—' END AS shown, printf('%.1f', round(p_partkey % 200 / 2, 1)) || '%' AS percent FROM part",
    "cluster_snapshots": "SELECT label, sha256('cluster-members-v1' || chr(10) || string_agg('i' || vec_id || ':' || CASE WHEN vec_id % 3 = 0 THEN 's' || vec_id ELSE '' END || ':c' || vec_id || ':p1', chr(10) ORDER BY 'i' || vec_id) || chr(10) || (SELECT string_agg(DISTINCT 'q' || z.vec_id % 3, chr(10) ORDER BY 'q' || z.vec_id % 3) FROM embeddings z WHERE z.label = e.label) || chr(10)) AS snapshot FROM embeddings e GROUP BY label",
    "memory_fold": f"WITH {_NAMED} SELECT * FROM mem",
    "attribute_profile": f"WITH {_NAMED}, h AS (SELECT character, 'h' || p_partkey % 3 AS value, count(*) AS n FROM mem JOIN part ON p_partkey = face WHERE p_partkey % 5 <> 0 GROUP BY 1, 2) SELECT character, value, round(n / sum(n) OVER (PARTITION BY character), 6) AS share FROM h",
    "visual_support": f"WITH {_NAMED} SELECT character, string_agg(CAST(face AS VARCHAR), '|' ORDER BY face) AS faces FROM mem GROUP BY character",
    "run_controls": f"WITH b AS (SELECT event_id % 50 AS run, max(CASE WHEN event_id % 50 < 30 THEN ts ELSE TIMESTAMP '2029-12-31 23:59:30' END) AS ts FROM events GROUP BY 1), c AS (SELECT event_id % 50 AS run, event_id AS seq, CASE WHEN event_id % 50 = 7 THEN 'cancel' WHEN event_id % 50 = 9 THEN 'finish' WHEN event_id % 2 = 0 THEN 'pause' ELSE 'resume' END AS c FROM events WHERE event_id % 3 = 0), g AS (SELECT run, bool_or(c = 'cancel') AS x, bool_or(c = 'finish') AS f, arg_max(c, seq) FILTER (c IN ('pause', 'resume')) AS l FROM c GROUP BY run) SELECT b.run, CASE WHEN x THEN 'cancelled' WHEN f THEN 'finished' WHEN l = 'pause' THEN 'paused' WHEN epoch(TIMESTAMP '{NOW}') - epoch(ts) > 60 THEN 'stalled' ELSE 'running' END AS status FROM b LEFT JOIN g ON g.run = b.run",
    "sealed_receipts": "SELECT o_orderkey % 40 AS revision, o_orderkey AS operation, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 40 % 3 = 0 THEN 'cached' ELSE 'completed' END AS outcome, o_orderkey % 40 % 3 = 0 AS sealed FROM orders",
    "tray_fold": "WITH c AS (SELECT event_id * 5 % 900 AS image, event_id AS seq, event_id % 7 AS a, event_id % 6 AS t FROM events), g AS (SELECT image, bool_or(a = 0) AS ar, arg_max(CASE a WHEN 1 THEN 'pending' WHEN 3 THEN 'unknown-foreign' ELSE 'deferred' END, seq) FILTER (a IN (1, 2, 3, 6)) AS mv, string_agg(DISTINCT CAST(t AS VARCHAR), '|' ORDER BY CAST(t AS VARCHAR)) FILTER (a IN (4, 5)) AS tr, count(*) FILTER (a IN (1, 2, 3, 6)) AS n FROM c GROUP BY image) SELECT i AS image, coalesce(ar, false) AS archived, CASE WHEN i % 3 = 0 AND mv IS NOT NULL THEN mv WHEN i % 2 = 0 THEN 'pending' ELSE 'assigned' END AS disposition, coalesce(tr, '') AS triggers, CASE WHEN i % 3 = 0 THEN 0 ELSE coalesce(n, 0) END AS refused FROM range(900) r(i) LEFT JOIN g ON g.image = i",
    "cache_states": "WITH q AS (SELECT DISTINCT o_orderkey % 4000 AS content, o_custkey % 3 AS namespace FROM orders) SELECT content, namespace, CASE WHEN p_partkey IS NULL THEN 'miss' WHEN p_partkey % 3 <> namespace THEN 'stale' WHEN p_partkey % 10 = 0 THEN 'corrupt' ELSE 'hit' END AS state FROM q LEFT JOIN part ON p_partkey = content",
    "decoded_payload": f"WITH {TIERED_SQL} SELECT position, proposed_tier, flags FROM tiered",
    "face_order": "SELECT o_custkey AS cluster, o_orderkey AS face, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 END NULLS LAST, o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS uncertain FROM orders",
    "effective_labels": "SELECT o_orderkey AS face, CASE WHEN o_orderkey % 7 = 0 THEN 'j' || o_orderkey % 4 WHEN o_orderkey % 5 = 0 THEN 'f' || o_orderkey % 4 WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey % 4 WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS label, CASE WHEN o_orderkey % 7 = 0 THEN 'journal' WHEN o_orderkey % 5 = 0 THEN 'face' WHEN c_custkey % 3 = 0 THEN 'cluster' WHEN c_custkey % 2 = 0 THEN 'confirmed' ELSE 'none' END AS source FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "candidate_sections": "WITH c AS (SELECT l_orderkey AS face, l_suppkey % 4 AS s, l_partkey AS name, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2, 3) SELECT face, " + ", ".join(f"coalesce(string_agg(CAST(name AS VARCHAR), '|' ORDER BY rank, name) FILTER (s = {i}), '') AS {n}" for i, n in enumerate(("model", "memory", "bucket"))) + " FROM c GROUP BY face",
    "draft_faults": """WITH m AS (SELECT o_custkey % 60 AS cluster, o_orderkey AS member, o_orderkey % 200 AS image, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 60 % 4 END AS label FROM orders), sz AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster),
d AS (SELECT m.cluster AS draft, 'split' AS action, CASE WHEN cluster % 5 = 4 THEN 59 - cluster ELSE cluster END AS cluster, member FROM m WHERE cluster < 20 AND (cluster % 4 = 0 OR member % 3 = 0)), mg AS (SELECT i AS draft, i AS cluster FROM range(20, 40) r(i) UNION ALL SELECT i, i + 20 FROM range(20, 40) r(i) WHERE i % 6 <> 0),
j AS (SELECT d.draft, d.action, d.cluster, d.member, m.image, m.label FROM d LEFT JOIN m ON m.cluster = d.cluster AND m.member = d.member UNION ALL SELECT mg.draft, 'merge', mg.cluster, m.member, m.image, m.label FROM mg JOIN m ON m.cluster = mg.cluster),
g AS (SELECT draft, max(action) AS a, count(DISTINCT j.cluster) AS cl, count(*) AS n, count(DISTINCT member) AS df, count(*) FILTER (image IS NULL) AS un, count(DISTINCT image) AS im, max(size) AS size, count(DISTINCT label) AS lb FROM j LEFT JOIN sz ON sz.cluster = j.cluster GROUP BY draft)
SELECT draft, CASE WHEN un > 0 THEN 'unknown-member' WHEN n <> df THEN 'overlap' WHEN a = 'split' AND cl <> 1 THEN 'one-cluster-required' WHEN a = 'split' AND df >= size THEN 'proper-parts-required' WHEN a = 'merge' AND cl < 2 THEN 'two-clusters-required' WHEN im < 10 THEN 'too-few-images' ELSE '' END AS fault, lb >= 2 AS conflict FROM g""",
    "restored_drafts": "WITH p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' END AS decision, CASE WHEN p_partkey % 8 = 0 THEN 'confirmed' WHEN p_partkey % 4 = 1 THEN 'rejected' END AS base FROM part) SELECT p_brand AS name, p_partkey AS tag, base, 'rejected' AS draft FROM p WHERE p_partkey % 6 <> 0 AND p_partkey % 3 <> 1 AND decision IS NOT DISTINCT FROM base",
    "exported_decisions": "WITH m AS (SELECT source AS folder, sha256(coalesce(text, '')) AS image FROM documents WHERE source IS NOT NULL), g AS (SELECT folder, count(DISTINCT image) AS images, sha256(string_agg(DISTINCT image, chr(10) ORDER BY image)) AS dg FROM m GROUP BY folder), s AS (SELECT DISTINCT coalesce(lang, 'none') AS scope, source AS folder FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'none', 'absent') SELECT scope, s.folder, coalesce(images, 0) AS images, coalesce(dg, sha256('')) AS members_digest, 'r1' AS report FROM s LEFT JOIN g ON g.folder = s.folder",
    "suggestion_tiers": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'verified' WHEN c_custkey % 3 <> 0 AND NOT (c_custkey % 4 <> 0 AND c_custkey % 7 = 0) THEN CASE WHEN c_custkey % 6 = 1 THEN 'model-unresolved' ELSE 'model' END ELSE 'none' END AS tier FROM customer",
}
