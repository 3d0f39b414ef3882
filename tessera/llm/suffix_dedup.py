"""Removal of byte strings of a given length that start earlier in the corpus, decided by suffix arrays.

The corpus is cut into shards by content: each run of windows that share a minimizer (the smallest hashed 36-gram of
a window) is a neighbourhood, and equal windows always fall under equal minimizers, so all places of a window meet in
one shard. Minimizers seen once are dropped. Equal neighbourhoods fold into their first one; what differs is
concatenated shard by shard, suffix-sorted by induced sorting, and permuted common prefixes give the windows that
occur earlier. Groups with more than BIG different neighbourhoods are decided by hashed windows instead, which are
pre-aggregated and so need no room for the group.

Null texts count as empty; rows with equal doc_id and equal text count as one document and get equal results; a null
doc_id sorts first, ids that aren't integers in their own order. Texts may be of any length. Extra columns are ignored.
Joins on a minimizer, or on a neighbourhood, salt those that hold more than a thousandth of all places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import HOT, HOT_ROWS, arrow_types, byte_slices, cut, drop, freed, importable, joined, map_arrow, parted, saved, table, trimmed
from .suffix_array import permuted_lcp, suffix_array

GRAM = 36
#: Different neighbourhoods of one minimizer from which hashed windows decide.
BIG = 20_000
#: Bytes that are suffix-sorted together.
SHARD = 1 << 20
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def runs(parts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, first window, windows, minimizer's hash) of each run of windows under one minimizer, some parts at a time."""
    span = length - GRAM + 1
    for a, b in byte_slices([len(x) for x in parts], 1 << 20):
        sizes = np.array([len(x) for x in parts[a:b]], np.int64)
        whole = b"".join(parts[a:b])
        ends, step = np.cumsum(sizes), (1 << 23)
        for lo in range(0, max(1, len(whole) - length + 1), step):
            data = np.frombuffer(whole[lo : lo + step + length - 1] + b"\0" * 8, np.uint8)
            n = len(data) - 8
            if n < length:
                continue
            v = np.ndarray((n,), "<u8", data, 0, (1,))
            w = np.ndarray((n,), "<u4", data, 0, (1,))
            m = n - GRAM + 1
            g = v[:m] * _MUL[0]
            for i in (8, 16, 24):
                g ^= g >> np.uint64(29)
                g += v[i : i + m] * _MUL[1]
            g ^= g >> np.uint64(31)
            g += w[32 : 32 + m] * _MUL[2]
            g ^= g >> np.uint64(32)
            g *= _MUL[3]
            g ^= g >> np.uint64(29)
            k = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
            width = 1
            while width * 2 <= span:
                k = np.minimum(k[:-width], k[width:])
                width *= 2
            if width < span:
                k = np.minimum(k[: len(k) - (span - width)], k[span - width :])
            at = (k & np.uint64(0xFFFFFF)).astype(np.int64)
            start = np.arange(len(at)) + lo
            part = np.searchsorted(ends, start, "right")
            ok = start + length <= ends[part]
            cutoff = np.ones(len(at), bool)
            cutoff[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(cutoff & ok)
            good = np.concatenate(([0], np.cumsum(ok)))
            stop = np.append(np.flatnonzero(cutoff), len(at))
            stop = stop[np.searchsorted(stop, first, "right")]
            count = good[stop] - good[first]
            p = part[first]
            yield p + a, start[first] - (ends[p] - sizes[p]), count, g[at[first]].view(np.int64)


def numbered(docs: DataFrame) -> DataFrame | None:
    """doc_id, did: a number for each id, in the ids' order; None where ids are integers and number themselves."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return None
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut(ids.select("doc_id", F.monotonically_increasing_id().alias("did")))


def keyed_with(docs: DataFrame, numbers: DataFrame | None, *more: Column) -> DataFrame:
    """did, k, b: the document's identity, with the text as bytes, and what else is wanted. Ids order documents, then the text's hash."""
    t, least = F.coalesce(F.col("text"), F.lit("")), F.lit(-(2**63))
    k, b = F.xxhash64(t).alias("k"), t.cast("binary").alias("b")
    if numbers is None:
        return docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("did"), k, b, *more)
    own = docs.select(F.col("doc_id").alias("_id"), k, b, *more)
    return own.join(numbers.withColumnRenamed("doc_id", "_id"), "_id", "left").withColumn("did", F.coalesce("did", least)).drop("_id")


def _hashes(length: int):
    def rows(batch: pa.RecordBatch) -> dict:
        return {"h": np.concatenate([np.empty(0, np.int64), *(h for *_, h in runs(batch.column(0).to_pylist(), length))])}

    return rows


def _occurrences(length: int):
    def rows(batch: pa.RecordBatch) -> dict:
        did, k, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        out, content = [], []
        for part, start, count, h in runs(parts, length):
            out.append((did[part], k[part], start << 7 | count, h))
            digest = xxhash.xxh3_64_intdigest
            content += [digest(parts[p][s : s + n]) for p, s, n in zip(part.tolist(), start.tolist(), (count + length - 1).tolist(), strict=True)]
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return dict(zip(("did", "k", "place", "h"), cols, strict=True)) | {"c": np.array(content, np.uint64).view(np.int64)}

    return rows


def _bytes_of(length: int):
    def rows(batch: pa.RecordBatch) -> dict:
        did, k, texts, places = (batch.column(i).to_pylist() for i in range(4))
        out = [(p["h"], did[i], k[i], p["start"], texts[i][p["start"] : p["start"] + p["n"] + length - 1]) for i in range(len(did)) for p in places[i]]
        return dict(zip(("h", "did", "k", "start", "b"), zip(*out, strict=True), strict=True)) if out else None

    return rows


def earlier_in_shard(places: list[tuple[int, int, int]], parts: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """(did, k, start, end) of what is covered by windows with an equal one at an earlier place, among these parts."""
    order = sorted(range(len(parts)), key=lambda i: places[i])
    sizes = np.array([len(parts[i]) for i in order], np.int64)
    text = np.frombuffer(b"".join(b"\0" + parts[i] for i in order), np.uint8).astype(np.uint16) + 2
    begin = np.cumsum(sizes + 1) - sizes
    text[begin - 1] = 1
    text = np.append(text, np.uint16(0))
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa)
    part = np.searchsorted(begin, np.arange(len(text)), "right") - 1
    valid = (part >= 0) & (np.arange(len(text)) + length <= (begin + sizes)[part])
    linked = lcp[sa] >= length
    group = np.cumsum(~linked)
    smallest = np.full(group[-1] + 1, len(text), np.int64)
    np.minimum.at(smallest, group, sa)
    again = np.zeros(len(text), bool)
    again[sa] = smallest[group] != sa
    p = np.flatnonzero(again & valid)
    if not len(p):
        return []
    new = np.flatnonzero(np.concatenate(([True], (np.diff(p) > 1) | (np.diff(part[p]) > 0))))
    last = np.append(new[1:], len(p)) - 1
    out = []
    for a, z in zip(p[new].tolist(), p[last].tolist(), strict=True):
        q = int(part[a])
        did, k, start = places[order[q]]
        out.append((did, k, start + a - int(begin[q]), start + z - int(begin[q]) + length))
    return out


def _shards(length: int, types: list[pa.DataType]):
    """Works through a partition sorted by h: whole groups of h, about SHARD bytes at a time. A place that comes twice, from rows that repeat, counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> pa.RecordBatch:
            got = earlier_in_shard([r[1:4] for r in rows], [r[4] for r in rows], length)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True) if got else [()] * 4, types, strict=True)], ["did", "k", "start", "end"])

        held, size, places = [], 0, set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    places = set()
                    if size >= SHARD:
                        yield solved(held)
                        held, size = [], 0
                if row[1:4] not in places:
                    places.add(row[1:4])
                    held.append(row)
                    size += len(row[4])
        if held:
            yield solved(held)

    return run


def _windows(length: int):
    def rows(batch: pa.RecordBatch) -> dict | None:
        out = []
        for _, did, k, start, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += [(xxhash.xxh3_128_digest(b[i : i + length]), did, k, start + i) for i in range(len(b) - length + 1)]
        return dict(zip(("w", "did", "k", "start"), zip(*out, strict=True), strict=True)) if out else None

    return rows


def removals(docs: DataFrame, length: int = 100, big: int = BIG, numbers: DataFrame | None = None) -> DataFrame:
    """did, k, spans: what is to be removed from each document, as (start, end) in no order; documents without are absent."""
    spark = docs.sparkSession
    keyed = keyed_with(docs, numbers)
    # a place is a run's first window and, in seven bits, its number of windows
    start, count = F.shiftright("place", 7), F.col("place").bitwiseAND(F.lit(127))
    again = map_arrow(keyed.select("b"), _hashes(length), "h long").groupBy("h").agg(F.count("*").alias("seen")).filter("seen > 1")
    again = cut(again)
    least = max(HOT_ROWS, (again.agg(F.sum("seen")).first()[0] or 0) // HOT)
    hot = cut(again.filter(F.col("seen") > least).select("h"))
    hot = hot if hot.limit(1).count() else None
    seen = map_arrow(keyed.select("did", "k", "b"), _occurrences(length), "did long, k long, place long, h long, c long")
    seen = saved(joined(seen, again.select("h"), ["h"], "left_semi", hot) if hot else seen.join(again.select("h").hint("shuffle_hash"), "h", "left_semi"))
    freed(spark)
    first = saved(seen.groupBy("h", "c").agg(F.min(F.struct("did", "k", "place")).alias("f"), F.count("*").alias("seen")))
    hot = cut(first.filter(F.col("seen") > least).select("h", "c"))
    hot = hot if hot.limit(1).count() else None
    earliest = first.filter("seen > 1").select("h", "c", "f")
    repeats = joined(seen, earliest, ["h", "c"], "inner", hot) if hot else seen.join(earliest, ["h", "c"])
    copies = repeats.filter(F.struct("did", "k", "place") != F.col("f")).select("did", "k", start.alias("start"), (start + count + (length - 1)).alias("end"))
    many = first.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    hot = cut(many.filter(F.col("kinds") > least).select("h"))
    hot = hot if hot.limit(1).count() else None
    places = first.select("h", "f.*")
    left = (joined(places, many, ["h"], "inner", hot) if hot else places.join(many, "h")).withColumns({"start": start, "n": count})
    wanted = saved(left.groupBy("did", "k").agg(F.collect_list(F.struct("h", "start", "n", "kinds")).alias("places")))
    there = wanted.join(parted(keyed.select("did", "k", "b"), wanted, ["did", "k"])[0], ["did", "k"]).select("did", "k", "b", "places")
    schema = "h long, did long, k long, start long, b binary"
    few = there.withColumn("places", F.filter("places", lambda p: p["kinds"] <= big)).filter(F.size("places") > 0)
    lots = there.withColumn("places", F.filter("places", lambda p: p["kinds"] > big)).filter(F.size("places") > 0)
    shard = map_arrow(few, _bytes_of(length), schema).repartition("h").sortWithinPartitions("h")
    out = "did long, k long, start long, end long"
    importable(spark)
    found = shard.mapInArrow(trimmed(_shards(length, arrow_types(spark, out))), out)
    spans, used = copies.union(found), [seen, first, wanted]
    if many.filter(F.col("kinds") > big).limit(1).count():
        windows = saved(map_arrow(map_arrow(lots, _bytes_of(length), schema), _windows(length), "w binary, did long, k long, start long"))
        used.append(windows)
        least_of = windows.groupBy("w").agg(F.min(F.struct("did", "k", "start")).alias("f"))
        spans = spans.union(joined(windows, least_of, ["w"]).filter(F.struct("did", "k", "start") != F.col("f")).select("did", "k", "start", (F.col("start") + length).alias("end")))
    done = cut(spans.groupBy("did", "k").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    drop(*used)
    freed(spark)
    return done


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _kept(batch: pa.RecordBatch) -> dict:
    ids, texts, spans = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
    n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
    for b, s in zip(texts, spans, strict=True):
        cuts = merged(s)
        if cuts:
            edges = [0, *(x for c in cuts for x in c), len(b)]
            rest = b"".join(b[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        else:
            rest = b
        n_bytes.append(len(b))
        n_removed.append(len(b) - len(rest))
        n_spans.append(len(cuts))
        sha.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest)
    return {"doc_id": ids, "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": sha, "kept": kept}


def _with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds each document's spans; only texts that have some are shuffled, unless their ids are too many to broadcast."""
    some, rest = parted(keyed, spans, ["did", "k"])
    if rest is None:
        return keyed.join(spans, ["did", "k"], "left")
    return some.join(spans, ["did", "k"]).unionByName(rest.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def suffix_dedup(docs: DataFrame, length: int = 100, big: int = BIG) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    numbers = numbered(docs)
    keyed = keyed_with(docs, numbers, F.col("doc_id"))
    out = _with_spans(keyed, removals(docs, length, big, numbers)).select("doc_id", "b", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(out, _kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _rewritten(names: list[str], types: list[pa.DataType]):
    """The documents' own columns, with the kept text; cut characters lose their rest, and texts that were removed whole go."""

    def rows(batch: pa.RecordBatch) -> dict:
        kept = _kept(batch.select(["did", "b", "spans"]))
        texts = [x.decode("utf-8", "ignore") for x in kept["kept"]]
        stay = pa.array([i for i, (t, n) in enumerate(zip(texts, kept["n_removed"], strict=True)) if t.strip() or not n], pa.int64())
        own = batch.column("row")
        cols = {own.type.field(i).name: own.field(i) for i in range(own.type.num_fields)}
        null = cols["text"].to_pylist()
        cols["text"] = pa.array([None if n else t for n, t in zip(null, texts, strict=True)], pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
        return {n: cols[n].take(stay).cast(t) for n, t in zip(names, types, strict=True)}

    return rows


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs, all columns whatever their names, with repeated byte strings cut from text; n_chars follows, and texts without a rest go.

    A null text stays null and an empty one empty; rows that repeat are cut alike, so each keeps what one of them would.
    """
    numbers = numbered(docs)
    spans = removals(docs, length, numbers=numbers)
    row = F.struct(*(F.col(f"`{c}`").isNull().alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)).alias("row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(_with_spans(keyed_with(docs, numbers, row), spans), _rewritten(docs.columns, arrow_types(docs.sparkSession, schema)), schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


#: Texts as hexadecimal digits, two a byte; windows are grouped by a digest. For tables whose windows fit into one machine.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n_bytes FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM n WHERE n_bytes >= 100)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM w) WHERE place > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM a)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT p.doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM p JOIN n ON n.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN k ON k.doc_id = n.doc_id
"""
