"""Queries of evidence bindings, selections and the predicates over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.skew import kept
from ..sources.tables import MANIFEST_SQL, manifest, table


def evidence_bindings(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + 10_000_000).otherwise(F.col("l_orderkey")).alias("face"), (F.col("l_orderkey") % 97 + F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0)).alias("image"), F.sha2(F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_suppkey") % 11 == 0, "x").otherwise("")), 256).alias("crop"), F.col("l_returnflag").alias("tag"))
    o = table(spark, d, "orders")
    got = evidence.bound_evidence(e, o.select(F.col("o_orderkey").alias("face"), (F.col("o_orderkey") % 97).alias("image")), o.select(F.col("o_orderkey").alias("face"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("crop")))
    return got.groupBy("tag", "status").agg(F.count("*").alias("n"), F.count_distinct("face").alias("faces"))


def bound_anchors(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 50).alias("crop")).distinct()
    saved = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("image"), (F.col("o_orderkey") % 50).alias("crop"))
    return evidence.bound_to(e, saved, ["image", "crop"])


def paired_scores(spark, d):
    """The best score of an image's faces beside the manifest's score, where both are there."""
    best = table(spark, d, "lineitem").filter("l_linenumber < 3").groupBy(F.col("l_partkey").alias("image")).agg(F.round(F.max(F.col("l_discount") + F.col("l_tax")), 6).alias("new"))
    old = table(spark, d, "part").select(F.col("p_partkey").alias("image"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") / 50).alias("old"))
    return old.join(best, "image").filter("old IS NOT NULL AND new IS NOT NULL").select("image", "old", "new")


def resolved_members(spark, d):
    members = table(spark, d, "orders").select((F.col("o_orderkey") % 5000).alias("member"), F.col("o_custkey").alias("image"))
    wanted = table(spark, d, "customer").select((F.col("c_custkey") * 7 % 6000).alias("member"))
    return evidence.exactly_one(wanted, members, "member", "image")


def supported_references(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.transform(F.sequence(F.lit(0), F.col("c_custkey") % 5), lambda i: (F.col("c_custkey") * 3 + i * 11) % 400).alias("refs"))
    relations = table(spark, d, "part").select((F.col("p_partkey") % 400).alias("ref"), (F.col("p_partkey") % 3 > 0).alias("verified"), F.when(F.col("p_size") % 4 == 0, "policy").otherwise("human").alias("source"), F.when(F.col("p_size") > 40, "pending").otherwise("assigned").alias("disposition"))
    return evidence.supported_refs(rows, relations).select("k", F.array_join(F.transform("refs", lambda x: x.cast("string")), "|").alias("refs"))


def consent_containment(spark, d):
    run = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("run"), (F.col("o_orderkey") % 60).alias("member"))
    given = table(spark, d, "lineitem").filter("l_returnflag <> 'R' OR l_orderkey % 40 < 30").select((F.col("l_orderkey") % 40).alias("run"), (F.col("l_partkey") % 60).alias("member"))
    return evidence.contained(run, given, "run", "member")


def archive_selections(spark, d):
    o = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("image"), (F.col("doc_id") % 60).alias("occurrence"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    chosen = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("image"), F.when(F.col("doc_id") % 9 == 0, 99).otherwise(F.col("doc_id") % 60).alias("occurrence")).distinct()
    return evidence.selections(chosen, o)


def before_after_scores(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    old = p.filter(k % 17 != 0).select(k.alias("k"), "p_brand", "p_size", F.round("p_retailprice", 2).alias("score"))
    new = p.filter(k % 19 != 0).select(k.alias("k"), F.when(k % 23 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 29 == 0, None).otherwise(F.col("p_size")).alias("p_size"), F.round(F.col("p_retailprice") + k % 5, 2).alias("score"))
    r = evidence.before_after(old, new, "k", ["p_brand", "p_size"], "score")
    return r.withColumn("delta", F.round("delta", 2))


def family_filmstrip(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("family"), (-F.col("o_totalprice")).alias("place"))
    return evidence.filmstrip(rows, 4).select("k", "size", F.array_join(F.transform("others", lambda x: x.cast("string")), "|").alias("others"))


def _clusters(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    members = o.select((F.col("o_custkey") % 30).alias("parent"), k.alias("member"), (k % 3000).alias("image"), F.sha2(k.cast("string"), 256).alias("digest"))
    frozen = o.select(k.alias("member"), F.when(k % 31 == 0, k % 3000 + 1).otherwise(k % 3000).alias("image"), F.sha2(k.cast("string"), 256).alias("digest"))
    records = spark.range(3000).filter("id % 37 <> 0").select(F.col("id").alias("image"), (F.col("id") % 30).alias("whole"))
    subjects = o.filter(k % 3000 % 2 == 0).filter(k % 41 != 0).select((k % 3000).alias("image"), k.alias("subject"), F.when(k % 5 != 0, F.col("o_custkey") % 30).otherwise(99).alias("cluster"))
    return members, frozen, records, subjects


def planned_members(spark, d):
    return evidence.cluster_members(*_clusters(spark, d)).groupBy("parent", "status").agg(F.count("*").alias("n"), F.min("member").alias("first"))


def parent_overlaps(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("half"), F.col("l_suppkey").alias("parent"), (F.col("l_partkey")).alias("member")).distinct()
    one = evidence.overlaps(m.filter("half = 'A'"), "parent", "member").withColumn("kind", F.lit("shared"))
    two = evidence.overlaps(table(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("member")), "parent", "member").withColumn("kind", F.lit("own"))
    return one.union(two)


def _bound_vectors(spark, d):
    v = table(spark, d, "embeddings")
    k = F.col("vec_id")
    mine = v.select(k.alias("k"), F.sha2(k.cast("string"), 256).alias("sha"), (k % 9).alias("crop"), F.when(k % 8 == 0, "profile-v0").otherwise("profile-v1").alias("profile"))
    frozen = v.filter(k % 21 != 0).select(k.alias("k"), F.when(k % 10 == 0, F.sha2(F.concat(F.lit("x"), k.cast("string")), 256)).otherwise(F.sha2(k.cast("string"), 256)).alias("sha"), F.when(k % 14 == 0, -1).otherwise(k % 9).alias("crop"), F.lit("profile-v1").alias("profile"))
    return mine, frozen


def vector_bindings(spark, d):
    mine, frozen = _bound_vectors(spark, d)
    return evidence.bound_to(mine, frozen, ["k", "sha", "crop", "profile"]).select("k", "bound")


def browser_commands(spark, d):
    """A command names a member; it stands if the member is in the manifest once and its record has the token that the browser saw."""
    c = table(spark, d, "events").select(F.col("event_id").alias("command"), (F.col("event_id") * 3 % 2500).alias("member"), (F.col("event_id") % 4).alias("seen"))
    m = table(spark, d, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("member"), (F.col("p_partkey") % 700).alias("image"))
    r = spark.range(700).filter("id % 13 <> 0").select(F.col("id").alias("image"), (F.col("id") % 4).alias("token"))
    j = c.join(m, "member", "left").join(r, "image", "left")
    status = evidence.reason(("unknown-member", F.col("image").isNull()), ("record-missing", F.col("token").isNull()), ("stale", F.col("token") != F.col("seen")), good="accepted")
    return j.select("command", "image", status.alias("status"))


def bound_candidates(spark, d):
    """Faces with their candidates; evidence under another image's name is none."""
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("face"), (F.col("o_custkey") % 50).alias("image"))
    e = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("face"), (F.col("l_orderkey") % 50).alias("image")).agg(F.count("*").alias("candidates"), F.max("l_quantity").alias("best"))
    return f.join(e, ["face", "image"], "left").select("face", "image", F.coalesce("candidates", F.lit(0)).alias("candidates"), "best")


def model_contradictions(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 7).cast("string").alias("name"), F.round(F.col("l_quantity") / 60, 2).alias("score"))
    m = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7).cast("string").alias("model"))
    return evidence.contradictions(c, m)


def _targets(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("k"), F.when(k % 4 == 0, "human").when(k % 4 < 3, "policy").alias("source"), F.when(k % 5 != 0, k % 3 == 0).alias("verified"), F.when(k % 7 != 0, k % 11 == 0).alias("excluded"),
        F.element_at(F.array(*(F.lit(x) for x in ("assigned", "pending", "deferred", "hypothesis", "archived", "unknown-foreign"))), (k % 6 + 1).cast("int")).alias("disposition"),
    )


_TARGETS = """t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'human' WHEN c_custkey % 4 < 3 THEN 'policy' END AS source, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 = 0 END AS verified, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 11 = 0 END AS excluded,
  ['assigned', 'pending', 'deferred', 'hypothesis', 'archived', 'unknown-foreign'][c_custkey % 6 + 1] AS disposition FROM customer)"""


def target_predicates(spark, d):
    c = F.col
    return _targets(spark, d).select("k", evidence.protected(c("source"), c("verified"), c("excluded")).alias("protected"), evidence.archivable(c("source"), c("verified"), c("disposition")).alias("archivable"))


def unresolved_pool(spark, d):
    t = _targets(spark, d).withColumns({"image": F.col("k") % 300, "subject": F.col("k")})
    asked = table(spark, d, "orders").filter("o_orderpriority LIKE '1%'").select((F.col("o_custkey") % 300).alias("image"), F.col("o_custkey").alias("subject"))
    return evidence.unresolved(t, asked)


def privacy(spark, d):
    m = manifest(spark, d).select("position", "nsfw_prob", F.when(F.col("position") % 9 == 0, "route_nsfw").when(F.col("position") % 9 != 1, "review").alias("tier"))
    return m.select("position", evidence.private(F.col("nsfw_prob"), F.col("tier")).alias("private"))


def output_checks(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("probability", "scalar", "pair", "vector"))), (k % 4 + 1).cast("int"))
    n = F.when(k % 13 == 0, 0).when(k % 4 == 2, 2).when(k % 11 == 0, 3).otherwise(1)
    value = F.when(k % 17 == 0, F.lit(float("nan"))).when(k % 19 == 0, F.lit(float("inf"))).otherwise((k % 30 - 5) / 20.0)
    values = F.when(k % 23 != 0, F.transform(F.slice(F.array(*(F.lit(i) for i in range(3))), F.lit(1), n), lambda i: value + i * 0))
    return table(spark, d, "part").select("p_partkey", evidence.output_faults(values, kind).alias("fault"))


def anchor_faces(spark, d):
    p = manifest(spark, d).select(F.col("brand").alias("label"), F.col("position").alias("face"), (F.col("position") * 7 % 40 / 40).alias("score"), F.rpad(F.substring("hash", 1, 12), 64, "0").alias("hash"))
    return evidence.anchors(kept(p), 0.3, 20)


def hash_limit(spark, d):
    docs = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return evidence.hash_ordered(docs, "sha256", 128)


def first_paths(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    return evidence.path_prefix(docs, 64)


def restored_projection(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    same = evidence.same_sets(o, o.filter("o_orderkey % 2 = 0").union(o.filter("o_orderkey % 2 <> 0"))).withColumn("kind", F.lit("whole"))
    return same.union(evidence.same_sets(o, o.filter("o_orderkey % 10 <> 0").union(o.filter("o_orderkey % 10 = 1"))).withColumn("kind", F.lit("torn")))


QUERIES = {f.__name__: f for f in (evidence_bindings, bound_anchors, paired_scores, resolved_members, supported_references, consent_containment, archive_selections, before_after_scores, family_filmstrip, planned_members, parent_overlaps, vector_bindings, browser_commands, bound_candidates, model_contradictions, target_predicates, unresolved_pool, privacy, output_checks, anchor_faces, hash_limit, first_paths, restored_projection)}

_DOCS = "o AS (SELECT sha256(coalesce(text, '')) AS image, doc_id % 60 AS occurrence, source || '/' || doc_id AS path, doc_id FROM documents)"
ORACLE = {
    "evidence_bindings": "WITH e AS (SELECT CASE WHEN l_linenumber = 7 THEN l_orderkey + 10000000 ELSE l_orderkey END AS face, l_orderkey % 97 + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS image, sha256(l_orderkey || CASE WHEN l_suppkey % 11 = 0 THEN 'x' ELSE '' END) AS crop, l_returnflag AS tag FROM lineitem) SELECT tag, CASE WHEN o_orderkey IS NULL THEN 'unknown-face' WHEN image <> o_orderkey % 97 THEN 'image-mismatch' WHEN crop <> sha256(CAST(o_orderkey AS VARCHAR)) THEN 'crop-mismatch' ELSE 'bound' END AS status, count(*) AS n, count(DISTINCT face) AS faces FROM e LEFT JOIN orders ON o_orderkey = face GROUP BY 1, 2",
    "bound_anchors": "SELECT DISTINCT l_suppkey AS image, l_partkey % 50 AS crop, (l_suppkey, l_partkey % 50) IN (SELECT (o_custkey % 100, o_orderkey % 50) FROM orders) AS bound FROM lineitem",
    "paired_scores": "SELECT p_partkey AS image, p_size / 50 AS old, round(max(l_discount + l_tax), 6) AS new FROM part JOIN lineitem ON l_partkey = p_partkey AND l_linenumber < 3 WHERE p_size % 4 <> 0 GROUP BY p_partkey, p_size",
    "resolved_members": "WITH w AS (SELECT DISTINCT c_custkey * 7 % 6000 AS member FROM customer), m AS (SELECT o_orderkey % 5000 AS member, count(*) AS n, min(o_custkey) AS image FROM orders GROUP BY 1) SELECT w.member, CASE WHEN n = 1 THEN image END AS image, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'one' END AS status FROM w LEFT JOIN m ON m.member = w.member",
    "supported_references": "WITH r AS (SELECT c_custkey AS k, unnest(range(0, c_custkey % 5 + 1)) AS i FROM customer), g AS (SELECT DISTINCT p_partkey % 400 AS ref FROM part WHERE p_partkey % 3 > 0 AND p_size % 4 <> 0 AND p_size <= 40) SELECT k, coalesce(string_agg(CAST((k * 3 + i * 11) % 400 AS VARCHAR), '|' ORDER BY i) FILTER (g.ref IS NOT NULL), '') AS refs FROM r LEFT JOIN g ON g.ref = (k * 3 + i * 11) % 400 GROUP BY k",
    "consent_containment": "WITH r AS (SELECT DISTINCT o_custkey % 40 AS run, o_orderkey % 60 AS member FROM orders), g AS (SELECT DISTINCT l_orderkey % 40 AS run, l_partkey % 60 AS member FROM lineitem WHERE l_returnflag <> 'R' OR l_orderkey % 40 < 30) SELECT r.run, count(*) AS members, count(*) - count(g.member) AS missing, count(*) = count(g.member) AS contained FROM r LEFT JOIN g ON g.run = r.run AND g.member = r.member GROUP BY r.run",
    "archive_selections": f"WITH {_DOCS}, n AS (SELECT image, occurrence, min(path) AS path, count(DISTINCT path) AS n FROM o GROUP BY 1, 2), c AS (SELECT DISTINCT image, CASE WHEN doc_id % 9 = 0 THEN 99 ELSE occurrence END AS occurrence FROM o) SELECT c.image, c.occurrence, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'excluded-ambiguous' ELSE 'selected' END AS status FROM c LEFT JOIN n ON n.image = c.image AND n.occurrence = c.occurrence",
    "before_after_scores": "WITH b AS (SELECT p_partkey AS k, p_brand, p_size, round(p_retailprice, 2) AS score FROM part WHERE p_partkey % 17 <> 0), a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 23 = 0 THEN 'other' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 29 <> 0 THEN p_size END AS p_size, round(p_retailprice + p_partkey % 5, 2) AS score FROM part WHERE p_partkey % 19 <> 0), j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS ia, b.k IS NOT NULL AS ib, concat_ws('|', CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' END, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END) AS ch, round(a.score - b.score, 2) AS delta FROM b FULL JOIN a ON a.k = b.k) SELECT k, CASE WHEN NOT ib THEN 'added' WHEN NOT ia THEN 'removed' WHEN ch <> '' THEN 'immutable-changed' ELSE 'paired' END AS status, CASE WHEN ia AND ib THEN ch ELSE '' END AS changed, delta FROM j",
    "family_filmstrip": "WITH r AS (SELECT o_orderkey AS k, o_custkey AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders) SELECT a.k, any_value(a.size) AS size, coalesce(string_agg(CAST(b.k AS VARCHAR), '|' ORDER BY b.n) FILTER (b.n <= CASE WHEN a.n <= 4 THEN 5 ELSE 4 END), '') AS others FROM r a LEFT JOIN r b ON b.f = a.f AND b.k <> a.k GROUP BY a.k",
    "planned_members": "WITH m AS (SELECT o_custkey % 30 AS parent, o_orderkey AS k, o_orderkey % 3000 AS image FROM orders), s AS (SELECT o_orderkey % 3000 AS image, o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 30 ELSE 99 END AS cl FROM orders WHERE o_orderkey % 3000 % 2 = 0 AND o_orderkey % 41 <> 0), j AS (SELECT m.*, s.k IS NOT NULL AS has, CASE WHEN m.image IN (SELECT image FROM s) THEN s.cl ELSE m.image % 30 END AS held, m.image IN (SELECT image FROM s) AS many FROM m LEFT JOIN s ON s.image = m.image AND s.k = m.k) SELECT parent, CASE WHEN k % 31 = 0 THEN 'cluster-manifest-binding' WHEN image % 37 = 0 THEN 'cluster-content-missing' WHEN many AND NOT has THEN 'cluster-subject-missing' WHEN held <> parent THEN 'stale-cluster-membership' ELSE 'planned' END AS status, count(*) AS n, min(k) AS first FROM j GROUP BY 1, 2",
    "parent_overlaps": "WITH m AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS m FROM lineitem WHERE l_returnflag = 'A') SELECT count(DISTINCT p) AS parents, count(*) AS members, count(DISTINCT m) AS merged, count(*) = count(DISTINCT m) AS disjoint, 'shared' AS kind FROM m UNION ALL SELECT count(DISTINCT o_custkey), count(*), count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey), 'own' FROM orders",
    "vector_bindings": "SELECT vec_id AS k, vec_id % 8 <> 0 AND vec_id % 21 <> 0 AND vec_id % 10 <> 0 AND vec_id % 14 <> 0 AS bound FROM embeddings",
    "browser_commands": "WITH c AS (SELECT event_id AS command, event_id * 3 % 2500 AS member, event_id % 4 AS seen FROM events) SELECT command, p_partkey % 700 AS image, CASE WHEN p_partkey IS NULL THEN 'unknown-member' WHEN p_partkey % 700 % 13 = 0 THEN 'record-missing' WHEN p_partkey % 700 % 4 <> seen THEN 'stale' ELSE 'accepted' END AS status FROM c LEFT JOIN part ON p_partkey = member AND p_partkey % 11 <> 0",
    "bound_candidates": "WITH e AS (SELECT l_orderkey AS face, l_orderkey % 50 AS image, count(*) AS n, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2) SELECT o_orderkey AS face, o_custkey % 50 AS image, coalesce(n, 0) AS candidates, best FROM orders LEFT JOIN e ON face = o_orderkey AND image = o_custkey % 50",
    "model_contradictions": "WITH c AS (SELECT DISTINCT l_orderkey AS k, CAST(l_suppkey % 7 AS VARCHAR) AS name, round(l_quantity / 60, 2) AS score FROM lineitem), b AS (SELECT k, max(score) AS m FROM c GROUP BY k HAVING max(score) > 0.35), l AS (SELECT c.* FROM c JOIN b ON b.k = c.k AND b.m = c.score), m AS (SELECT o_orderkey AS k, CAST(o_custkey % 7 AS VARCHAR) AS model FROM orders WHERE o_orderkey % 3 <> 0) SELECT l.k, l.name, l.score, m.model FROM l JOIN m ON m.k = l.k WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.k = l.k AND x.name = m.model)",
    "target_predicates": f"WITH {_TARGETS} SELECT k, coalesce(source = 'human', false) OR coalesce(verified, false) OR coalesce(excluded, false) AS protected, coalesce(verified AND source = 'human' AND disposition IN ('assigned', 'unknown-foreign', 'archived'), false) AS archivable FROM t",
    "unresolved_pool": f"WITH {_TARGETS} SELECT k % 300 AS image, k AS subject FROM t WHERE NOT coalesce(verified, false) AND NOT coalesce(excluded, false) AND disposition IN ('pending', 'deferred', 'hypothesis') OR k IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "privacy": f"WITH {MANIFEST_SQL} SELECT position, coalesce(nsfw_prob >= 0.65, false) OR position % 9 = 0 AS private FROM manifest",
    "output_checks": "WITH v AS (SELECT p_partkey, p_partkey % 4 AS kind, CASE WHEN p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 4 = 2 THEN 2 WHEN p_partkey % 11 = 0 THEN 3 ELSE 1 END AS n, p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS bad, (p_partkey % 30 - 5) / 20 AS x FROM part) SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN 'missing' WHEN bad AND n > 0 THEN 'nonfinite' WHEN CASE kind WHEN 2 THEN n <> 2 WHEN 3 THEN n = 0 ELSE n <> 1 END THEN 'shape' WHEN kind = 0 AND NOT x BETWEEN 0 AND 1 OR kind = 2 AND x < 0 THEN 'range' ELSE '' END AS fault FROM v",
    "anchor_faces": f"WITH RECURSIVE {MANIFEST_SQL}, f AS (SELECT brand AS label, position AS face, substr(hash, 1, 12) AS h, row_number() OVER (PARTITION BY brand ORDER BY position * 7 % 40 / 40 DESC, position) AS n FROM manifest WHERE position * 7 % 40 / 40 >= 0.3), b AS (SELECT *, ('0x' || h)::UBIGINT AS x FROM f), e AS MATERIALIZED (SELECT p.label, p.n AS a, q.n AS b FROM b p JOIN b q ON p.label = q.label AND p.n < q.n AND bit_count(xor(p.x, q.x)::BIT) <= 4), m AS MATERIALIZED (SELECT b.*, (SELECT list(a) FROM e WHERE e.label = b.label AND e.b = b.n) AS near FROM b), r AS (SELECT label, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS got FROM (SELECT DISTINCT label FROM b) UNION ALL SELECT r.label, r.n + 1, CASE WHEN len(list_intersect(coalesce(m.near, []), r.got)) > 0 THEN r.got ELSE list_append(r.got, m.n) END FROM r JOIN m ON m.label = r.label AND m.n = r.n + 1), z AS (SELECT label, arg_max(got, n) AS got FROM r GROUP BY label) SELECT z.label, face, list_position(got, m.n) AS rank FROM z JOIN m ON m.label = z.label AND list_contains(got, m.n) WHERE list_position(got, m.n) <= 20",
    "hash_limit": "SELECT sha256(coalesce(text, '')) AS sha256, min(source || '/' || doc_id) AS path, count(*) AS paths FROM documents GROUP BY 1 ORDER BY 1 LIMIT 128",
    "first_paths": "SELECT coalesce(source, '') || '/' || doc_id AS path, doc_id FROM documents ORDER BY path LIMIT 64",
    "restored_projection": "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, true AS same, 'whole' AS kind UNION ALL SELECT count(*) FILTER (o_orderkey % 10 = 0), count(*) FILTER (o_orderkey % 10 = 1), false, 'torn' FROM orders",
}
