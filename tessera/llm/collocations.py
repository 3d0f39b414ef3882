"""Phrases whose words meet more often than their parts would by chance, mined from vertical positional lists.

A task cuts its texts into blocks of one language. A block holds, for each phrase that may be frequent, the sorted
positions at which it starts; a list's length is the phrase's exact frequency in the block, and lengths are added up over
all blocks. A frequent phrase is extended by merging its positions with the postings of the adjacent word, narrowed to
those places where the words before it are a frequent phrase, too: occurrences at neighbouring positions make the next,
longer list. Only lengths are moved, added up before the shuffle; no position leaves its block, and no phrase's
occurrences ever meet in one task.

A phrase is told by two frequent shorter ones, its words without the last and without the first, each by a hash of 64
bits of its own two; from these come its words, and the frequencies of all its beginnings and ends, so every cut is
scored without another count. If two frequent phrases share a hash, all is done again with other hashes. Blocks learn
which phrases are frequent from a bitmap of BITS bits, whatever the number of phrases: a frequent phrase always passes,
and of others only some (more of them the fuller it is), whose longer lists are counted in vain and never kept.

Null and empty texts have no words; a null language is `und`. Texts may be of any length, as a block takes whole texts.
Repeated rows count each. Equal scores are ordered by frequency and then by the phrase's bytes. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import placed_within
from .common import ARROW, drop, freed, importable, joined, saved, table, trimmed
from .words import Words, kinds, split

#: Longest phrase, least occurrences, rows of each language, bytes of texts from which a block is closed.
LONGEST, LEAST, TOP, BLOCK = 5, 100, 2000, 16 << 20
#: Bits that tell blocks which phrases of a length are frequent.
BITS = 1 << 27
#: Pieces end at these bytes, words at these or at a space or tab.
PIECES = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
UNKNOWN = "und"
#: Spark's seed of xxhash64, and the function's constants (fixed values).
_SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hash(x: np.ndarray, seed: np.ndarray | np.uint64 = np.uint64(_SEED)) -> np.ndarray:
    """xxhash64 of one number, after others whose hash is the seed."""
    h = _turned((seed + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _passing(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which ids the bitmap holds, at both of their bits."""
    on = np.ones(len(ids), bool)
    for at in (ids, _hash(ids)):
        at = at & np.uint64(len(bits) * 8 - 1)
        on &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return on


def _bitmap(frequent: DataFrame, size: int) -> Broadcast:
    """The ids' bits; what passes through the driver is their `size` bits, whatever the number of ids."""
    at = lambda h: h.bitwiseAND(F.lit(size - 1))
    bits = frequent.select(F.explode(F.array(at(F.col("id")), at(F.xxhash64("id")))).alias("at"))
    part = min(size, 1 << 15)
    rows = bits.groupBy(F.floor(F.col("at") / part).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % part).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)[: part // 8]
    return frequent.sparkSession.sparkContext.broadcast(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Each block's languages with their texts' words."""

    def closed(held: list[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        langs = rows["lang"].combine_chunks().dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            w = split(rows["text"].filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == code)).combine_chunks(), PIECES)
            if len(w.codes):
                yield lang, w

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            yield from closed(held)
            held, size = [], 0
    if held:
        yield from closed(held)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of each block."""
    for lang, w in _blocks(batches):
        n = np.bincount(w.codes, minlength=len(w.distinct))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), w.distinct.cast(pa.large_string()).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])


def _longer(bitmaps: list[Broadcast], salt: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b, n of each block's phrases that are a word longer than the bitmaps go: of the phrases without the last and the
    first word, by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, w in _blocks(batches):
            head = f"{salt}{len(lang)}:{lang}".encode()
            own = np.fromiter((xxhash.xxh64_intdigest(head + x.as_py(), _SEED) for x in w.distinct), np.uint64, len(w.distinct))
            # positions leave a gap where a piece ends
            places = np.arange(len(w.codes)) + np.append(0, np.cumsum(np.diff(w.pieces) != 0))
            on = _passing(own, bitmaps[0].value)[w.codes]
            places, ids = places[on], own[w.codes[on]]
            for level in range(1, len(bitmaps) + 1):
                met = np.flatnonzero(np.diff(places) == 1)
                places, first, second = places[met], ids[met], ids[met + 1]
                ids = _hash(second, _hash(first))
                if level < len(bitmaps):
                    on = _passing(ids, bitmaps[level].value)
                    places, ids = places[on], ids[on]
            if not len(ids):
                continue
            # a phrase's list is what has its id; lists are told by both ids they are made of
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            heads = np.flatnonzero(np.append(True, (np.diff(first) != 0) | (np.diff(second) != 0)))
            yield pa.RecordBatch.from_arrays([pa.array(first[heads].view(np.int64)), pa.array(second[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(first))))], ["a", "b", "n"])

    return run


class _Shared(Exception):
    """Two frequent phrases have one id."""


def _told(frequent: DataFrame) -> DataFrame:
    kept = saved(frequent)
    if kept.count() > kept.select("id").distinct().count():
        raise _Shared
    return kept


def _phrases(texts: DataFrame, longest: int, least: int, salt: str) -> list[DataFrame]:
    counted = lambda rows, *names: rows.groupBy(*names).agg(F.sum("n").alias("f"))
    each = saved(counted(texts.mapInArrow(trimmed(_words), "lang string, word string, n long"), "lang", "word"))
    total = each.groupBy("lang").agg(F.sum("f").alias("n"))
    words = joined(each.filter(F.col("f") >= least), total, ["lang"])
    out = [_told(words.select(F.xxhash64(F.concat(F.lit(salt), F.length("lang").cast("string"), F.lit(":"), "lang", "word")).alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", "n", F.array("f").alias("pre"), F.array("f").alias("suf")))]
    drop(each)
    bitmaps = []
    for _ in range(longest - 1):
        bitmaps.append(_bitmap(out[-1], BITS))
        pairs = texts.mapInArrow(trimmed(_longer(list(bitmaps), salt)), "a long, b long, n long")
        frequent = saved(counted(pairs, "a", "b").filter(F.col("f") >= least))
        left = out[-1].select(F.col("id").alias("a"), "lang", "phrase", "n", "pre")
        right = out[-1].select(F.col("id").alias("b"), "last", "suf")
        both = joined(saved(joined(frequent, left, ["a"])), right, ["b"])
        more = lambda c: F.concat(c, F.array("f")).alias(c)
        out.append(_told(both.select(F.xxhash64("a", "b").alias("id"), "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "n", more("pre"), more("suf"), "a", "b")))
        freed(texts.sparkSession)
    return out


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """Tables of the frequent words, pairs, ... up to `longest` words: id, lang, phrase, last (word), f, n (words of the
    language), pre and suf (frequencies of the first and of the last 1, 2, ... words) and, from pairs on, a and b, the
    ids of the phrases without the last and without the first word."""
    spark = docs.sparkSession
    importable(spark)
    for k, v in ARROW.items():
        spark.conf.set(k, v)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text").filter("text IS NOT NULL")
    salt = ""
    while True:
        try:
            return _phrases(texts, longest, least, salt)
        except _Shared:
            salt += "+"


def _cuts(words: int) -> Column:
    """score, cut, l, r of the lowest-scoring cut; products of more than 64 bits are decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * (wide(F.col("f")) * wide(F.col("n")).cast("decimal(15,0)"))).cast("decimal(38,0)")

    def cut(k: int) -> Column:
        left, right = F.get("pre", F.lit(k - 1)), F.get("suf", F.lit(words - k - 1))
        score = F.call_function("div", top, (wide(left) * wide(right).cast("decimal(18,0)")).cast("decimal(38,0)"))
        return F.struct(score.alias("score"), F.lit(k).alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*(cut(k) for k in range(1, words))))


def candidates(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score and covered (a longer candidate stands wherever it does) of every phrase of
    two to `longest` words."""
    levels, out = phrases(docs, longest, least), None
    for words, level in enumerate(levels[1:], 2):
        if words < longest:
            over = levels[words].select(F.col("a").alias("id"), F.col("f").alias("top")).union(levels[words].select("b", "f"))
            level = level.join(over.groupBy("id").agg(F.max("top").alias("top")), "id", "left").withColumn("covered", F.coalesce(F.col("top") >= F.col("f"), F.lit(False)))
        else:
            level = level.withColumn("covered", F.lit(False))
        scored = level.withColumn("best", _cuts(words))
        rows = scored.select("lang", "phrase", F.lit(words).alias("words"), F.col("f").alias("a"), "best.l", "best.r", "n", "best.score", "covered")
        out = rows if out is None else out.union(rows)
    return out


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases that no longer one covers."""
    # placed_within() has a column n of its own
    best = candidates(docs, longest, least).filter("NOT covered").withColumnRenamed("n", "total")
    best = placed_within(best, ["lang"], F.col("score").desc(), F.col("a").desc(), F.col("phrase")).drop("n")
    return best.filter(F.col("place") < top).select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
k AS (SELECT unnest(range(1, 6)) AS k),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, k WHERE len(w) >= k),
f AS (SELECT lang, k, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n.n, j AS cut,
    CAST((1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[j + 1:], ' ')
  JOIN n ON n.lang = c.lang),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
part AS (
  SELECT lang, f, k, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(g[i:i + m - 1], ' '))))) AS phrase
  FROM c),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN part ON part.lang = c.lang AND part.phrase = c.phrase AND part.k > c.k AND 100 * part.f >= 100 * c.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM gone)
QUALIFY rank <= 2000
"""
