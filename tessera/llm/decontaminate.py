"""Benchmark decontamination: hashed windows of benchmark words, matched against the windows of every text.

DataFrame operations only. A text's word windows are hashed in place and exploded into a join with the benchmark's
hashes; then the words themselves are compared, so a colliding hash is never a hit. The benchmark's windows are
broadcast up to BROADCAST bytes. Beyond that they are first cut down to the windows whose hash occurs in some text,
found by counting the texts' hashes; if these are still too large, places and hashes (not texts) are shuffled to them,
with salts for the hashes that hold more than a thousandth of all places, and the candidates go back to their texts.

Null texts and texts without words have no windows; texts may be of any length. Repeated rows are judged each for
itself, which gives equal rows. Items of equal id count as one; an item whose id is null is matched but not listed.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, HOT_ROWS, cut, identity, joined, let, table, text_hash, without

WINDOW = 13
#: Bytes of benchmark windows (words, hashes and item ids) up to which they are broadcast.
BROADCAST = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = -1


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = F.transform(parts, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))
    return F.filter(low, lambda w: w != "")


def _windows(hashes: Column, k: int) -> Column:
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, k)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, n, t, items: hash, length, words and item ids of each different window."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window))).select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("v"))
    w = w.select("item", "n", F.array_join("v", " ").alias("t"), F.xxhash64(F.transform("v", lambda x: F.xxhash64(x))).alias("h"))
    return w.groupBy("h", "n", "t").agg(F.collect_set("item").alias("items"))


def _bytes(bench: DataFrame) -> int:
    each = F.lit(64) + F.octet_length("t") + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16), F.lit(0))
    return bench.agg(F.sum(each)).first()[0] or 0


def _hashed(w: Column, kinds: list[int]) -> Column:
    """The hashes of all windows of the given lengths, those of the first length first; last a number of its own, so that no text has none."""
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda hs: F.concat(*(_windows(hs, k) for k in kinds), F.array(F.lit(_END).cast("long"))))


def _place(kinds: list[int]) -> tuple[Column, Column]:
    """First word (from 0) and length of the window at place `at` of _hashed(), given n_words; length 0 stands for the end."""
    n, pos, length, before = F.col("n_words"), F.lit(0), F.lit(0), F.lit(0)
    for k in kinds:
        here = F.greatest(n - (k - 1), F.lit(0))
        inside = (F.col("at") >= before) & (F.col("at") < before + here)
        pos, length = F.when(inside, F.col("at") - before).otherwise(pos), F.when(inside, F.lit(k)).otherwise(length)
        before = before + here
    return pos, length


def _exploded(docs: DataFrame, kinds: list[int], *keep: str) -> DataFrame:
    """The outer form, as Spark would compute all hashes twice to filter what the other form lets go."""
    d = docs.withColumn("hs", _hashed(F.col("w"), kinds))
    return d.select(*keep, F.size("w").alias("n_words"), F.posexplode_outer("hs").alias("at", "dh"))


def _by_broadcast(docs: DataFrame, bench: DataFrame, kinds: list[int]) -> DataFrame:
    """doc_id, n_words, hits and items: texts are read once and only hits are shuffled."""
    end = bench.sparkSession.range(1).select(F.lit(_END).cast("long").alias("h"), F.lit(0).alias("n"), F.lit("").alias("t"), F.array().cast("array<string>").alias("items"))
    own = docs.select("doc_id", text_hash().alias("k"), words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    d = _exploded(own, kinds, "doc_id", "k", "row", "w")
    pos, length = _place(kinds)
    said = F.array_join(F.slice("w", pos + 1, length), " ")
    # two comparisons instead of an equality, which the optimizer would make a join key and compute for every window
    same = (F.col("dh") == F.col("h")) & (length >= F.col("n")) & (length <= F.col("n")) & (said >= F.col("t")) & (said <= F.col("t"))
    hits = d.join(F.broadcast(bench.union(end)), same).select("doc_id", "k", "row", "n_words", pos.alias("pos"), "n", "items")
    return hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("k").alias("k"), F.max("n_words").cast("long").alias("n_words"), F.collect_list(F.when(F.col("n") > 0, F.struct("pos", "n"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).drop("row")


def _by_shuffle(docs: DataFrame, bench: DataFrame, kinds: list[int], counts: DataFrame) -> DataFrame:
    """The same for any number of windows: what is shuffled is (document, place, hash), then each document's candidates."""
    own = docs.select("doc_id", identity(docs).alias("who"), text_hash().alias("k"), words(F.col("text")).alias("w"))
    pos, length = _place(kinds)
    d = _exploded(own, kinds, "who").filter(F.col("dh") != _END).select("who", "dh", pos.alias("pos"), length.alias("length"))
    total = counts.agg(F.sum("places")).first()[0] or 0
    hot = cut(counts.filter(F.col("places") > max(HOT_ROWS, total // HOT)).select("dh"))
    side = bench.groupBy("h").agg(F.collect_list(F.struct("n", "t", "items")).alias("windows")).withColumnRenamed("h", "dh")
    met = joined(d, side, ["dh"], "inner", hot) if hot.limit(1).count() else d.join(side, "dh")
    met = met.select("who", "pos", F.explode(F.filter("windows", lambda x: x["n"] == F.col("length"))).alias("x"))
    met = met.groupBy("who").agg(F.collect_set(F.struct("pos", "x.n", "x.t", "x.items")).alias("found"))
    j = own.join(met, "who", "left")
    true = F.filter("found", lambda x: F.array_join(F.slice("w", x["pos"] + 1, x["n"]), " ") == x["t"])
    j = j.withColumn("found", F.coalesce(true, F.array().cast(met.schema["found"].dataType)))
    return j.select("doc_id", "k", F.size("w").cast("long").alias("n_words"), F.transform("found", lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"))).alias("hits"), F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))).alias("items"))


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, k (its text's hash), n_words, hits (pos, n) and the items whose windows occur."""
    bench = cut(benchmark_windows(items, window))
    kinds = sorted(r["n"] for r in bench.select("n").distinct().collect())  # window lengths, from 1 to `window`
    if _bytes(bench) <= BROADCAST:
        return _by_broadcast(docs, bench, kinds)
    hashes = _exploded(docs.select(words(F.col("text")).alias("w")), kinds).groupBy("dh").agg(F.count("*").alias("places"))
    counts = cut(hashes.join(bench.select(F.col("h").alias("dh")).distinct(), "dh", "left_semi"))
    bench = cut(bench.join(counts.select(F.col("dh").alias("h")), "h", "left_semi"))
    return _by_broadcast(docs, bench, kinds) if _bytes(bench) <= BROADCAST else _by_shuffle(docs, bench, kinds, counts)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, the hit spans of words as (start, end), and k, the text's hash."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("hits", start, lambda a, x: F.struct(F.greatest(a["end"], x["pos"] + x["n"]).alias("end"), (a["n"] + F.greatest(x["pos"] + x["n"] - F.greatest(a["end"], x["pos"]), F.lit(0))).alias("n")), lambda a: a["n"])
    out = matched(docs, items, window).withColumn("hits", F.sort_array("hits")).withColumn("n_hit", covered)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.transform("hits", lambda x: F.struct(x["pos"].alias("start"), (x["pos"] + x["n"]).alias("end"))).alias("spans"),
        "k",
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, without contaminated documents; of rows that share a doc_id only those of a contaminated text go."""
    same = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("doc_id").isNull().alias("n"), F.col("k").alias("k"))
    return without(docs, contamination(docs, items, window).filter("contaminated").select(same.alias("gone")))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "k")


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
b AS (SELECT item, least(len(w), 13) AS n, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0),
bt AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM b),
ks AS (SELECT DISTINCT n FROM bt),
d AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ks WHERE len(w) >= n),
dt AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM d),
hit AS (SELECT dt.doc_id, dt.n, dt.i, bt.item FROM dt JOIN bt ON dt.n = bt.n AND dt.t = bt.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""
