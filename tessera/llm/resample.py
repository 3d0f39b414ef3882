"""Importance resampling towards a target distribution of hashed word n-grams.

A feature's bucket is the CRC-32 of its words, joined by one space, modulo the number of buckets. Each distinct word of
a batch is read once for its CRC; the CRC of a longer run follows from those of its parts, as a CRC is linear over GF(2):
that of a joined string is the first part's, multiplied by the matrix that shifts it by the second part's length, plus
the second part's. No n-gram is ever written out. Buckets are counted over all documents and all target texts; what
meets in the driver and is sent to the workers is one number for each bucket, whatever the size of the tables.

A document's weight is the sum of its features' gains, its score the weight and a Gumbel number that its doc_id gives,
so that the highest scores are a draw without replacement in proportion to exp(weight / 1000). Places in this order come
from ranges that are sorted side by side.

Null and empty texts have no feature, weight 0 and are never drawn. A null doc_id counts as an empty string and comes
last among equal scores. Repeated rows each count and each have a place, equal but for that. Texts may be of any length;
empty tables give empty results; extra columns are ignored by importance() and kept by resampled().
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import placed
from .common import ARROW, importable, map_arrow, saved, table
from .words import PLAIN, split

#: Longest runs of words, buckets, the seed of the draw, percent drawn, least words of a drawn document.
RUN, BUCKETS, SEED, PERCENT, LEAST = 1, 10_000, 2024, 10, 20


def _spread(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns, as four tables for the bytes of what it is multiplied with."""
    out = np.zeros((4, 256), np.uint32)
    for i in range(32):
        out[i // 8, (np.arange(256) >> (i % 8)) & 1 == 1] ^= columns[i]
    return out


def _times(spread: np.ndarray, x: np.ndarray) -> np.ndarray:
    return spread[0][x & 255] ^ spread[1][(x >> 8) & 255] ^ spread[2][(x >> 16) & 255] ^ spread[3][x >> 24]


def _shifts() -> list[np.ndarray]:
    """Matrices that shift a CRC by 1, 2, 4, 8, ... bytes: each is the square of the one before."""
    m = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # by one bit
    out = []
    for k in range(3 + 40):
        if k >= 3:
            out.append(_spread(m))
        m = _times(_spread(m), m)
    return out


SHIFTS = _shifts()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of strings, each followed by so many bytes, but for those bytes' own CRC."""
    out = crcs.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = (lengths >> k) & 1 == 1
        out[on] = _times(SHIFTS[k], out[on])
    return out


def run_crcs(texts: pa.Array, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """ends (words up to each text's end, from 0 on) and, for each length of run, the CRCs of all runs and of each the place of its first word."""
    w = split(texts, PLAIN)
    size = w.lengths()
    own = np.fromiter((zlib.crc32(x.as_py()) for x in w.distinct), np.uint32, len(w.distinct))
    spaced = shifted(np.full(len(own), zlib.crc32(b" "), np.uint32), size) ^ own  # of a space and the word
    text = np.repeat(np.arange(len(w.ends) - 1), np.diff(w.ends))
    crcs, out = own[w.codes], []
    for n in range(1, longest + 1):
        if n > 1:
            last = w.codes[n - 1 :]
            crcs = shifted(crcs[:-1], 1 + size[last]) ^ spaced[last]
        whole = np.flatnonzero(text[: len(crcs)] == text[n - 1 :])
        out.append((crcs[whole], whole))
    return w.ends, out


def bucket_counts(docs: DataFrame, longest: int = RUN, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket that has some, over all texts."""

    def rows(batch: pa.RecordBatch) -> dict:
        n = sum(np.bincount(c % buckets, minlength=buckets) for c, _ in run_crcs(batch["text"], longest)[1])
        return {"bucket": np.flatnonzero(n), "n": n[n > 0]}

    counted = map_arrow(docs.select("text"), rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counted.collect()}  # a row for each bucket at most


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln(target's share / source's share)) of each bucket, one feature added to each."""
    s, t = sum(source.values()), sum(target.values())
    share = lambda b: float(target.get(b, 0) + 1) * float(s + buckets) / (float(source.get(b, 0) + 1) * float(t + buckets))
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray, longest: int, text: str = "text") -> Column:
    """words, features and weight of a text, as a struct."""
    spark = docs.sparkSession
    importable(spark)
    for k, v in ARROW.items():
        spark.conf.set(k, v)
    sent = spark.sparkContext.broadcast(gain)

    def rows(texts: pa.Array) -> pa.Array:
        ends, runs = run_crcs(texts, longest)
        features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for crcs, at in runs:
            bounds = np.searchsorted(at, ends)
            total = np.append(0, np.cumsum(sent.value[crcs % len(sent.value)]))[bounds]
            features, weight = features + np.diff(bounds), weight + np.diff(total)
        return pa.StructArray.from_arrays([pa.array(np.diff(ends)), pa.array(features), pa.array(weight)], ["words", "features", "weight"])

    return F.arrow_udf(rows, "struct<words:bigint,features:bigint,weight:bigint>")(F.col(text))


def _luck(doc_id: Column, seed: int) -> Column:
    """A Gumbel number of a document, times 1000 and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _scored(docs: DataFrame, target: DataFrame, longest: int, buckets: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    w = docs.select("doc_id", _weighed(docs, gain, longest).alias("w"))
    return saved(w.select("doc_id", F.col("w.words").alias("n_words"), F.col("w.features").alias("n_features"), F.col("w.weight").alias("weight"), (F.col("w.weight") + _luck(F.col("doc_id"), seed)).alias("score"))), gain


def _drawn(scored: DataFrame, percent: int, least: int) -> tuple[DataFrame, int]:
    """Documents of enough words with their place by score, and how many are drawn."""
    enough = scored.filter(F.col("n_words") >= least)
    return placed(enough, F.col("score").desc(), F.col("doc_id").asc_nulls_last()), percent * enough.count() // 100


def importance(docs: DataFrame, target: DataFrame, longest: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null: not drawn) of every document."""
    scored, _ = _scored(docs, target, longest, buckets, seed)
    ordered, drawn = _drawn(scored, percent, least)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ordered.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.union(scored.filter(F.col("n_words") < least).select(*columns, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, longest: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """The drawn rows of docs, all columns. Texts aren't shuffled: rows are held against the last drawn one's score and
    doc_id (rows that repeat it are drawn with it)."""
    scored, gain = _scored(docs, target, longest, buckets, seed)
    ordered, drawn = _drawn(scored, percent, least)
    last = ordered.filter(F.col("place") == drawn - 1).select("score", "doc_id").first() if drawn else None
    if last is None:
        return docs.limit(0)
    w = _weighed(docs, gain, longest)
    score = w["weight"] + _luck(F.col("doc_id"), seed)
    tie = F.lit(True) if last["doc_id"] is None else F.col("doc_id") <= F.lit(last["doc_id"])
    return docs.filter((w["words"] >= least) & ((score > last["score"]) | ((score == last["score"]) & F.coalesce(tie, F.lit(False)))))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


OP11_SQL = r"""
WITH RECURSIVE bits(b, i, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
bytes AS (SELECT list(c ORDER BY b) AS tbl FROM bits WHERE i = 8),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
voc AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
crc AS (
  SELECT word,
    xor(list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
      lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM voc, bytes),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
n AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM dw) AS sn, (SELECT CAST(count(*) AS DOUBLE) FROM bw) AS tn),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000) / ((s + 1)::DOUBLE * (tn + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), n),
f AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crc USING (word) JOIN g USING (bucket) GROUP BY row),
x AS (
  SELECT row, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN f USING (row)),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM r) * 10 // 100 THEN place END AS rank
FROM sc LEFT JOIN r USING (row)
"""
