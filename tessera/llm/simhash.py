"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are taken once for each document and folded to distinct ones. Their bits are grouped into partitions of
correlated bits; a dynamic programme gives each partition a threshold (-1: not probed) so that the thresholds add up
to distance - partitions + 1, at the least expected number of keys and candidate pairs; then any two fingerprints
within the distance agree in some partition up to its threshold. Each fingerprint emits a key for each choice of
masked bits, groups of a key are verified block by block, and only a spanning forest of each group leaves the task.
Components are found by distributed label passing. Groups of more than BLOCK fingerprints are probed again with the
bits outside their mask; groups that are larger even then are dealt out as pairs of blocks.

Null texts count as empty; repeated rows and rows of equal doc_id are kept as rows; a null doc_id is in its component
but names none. Texts may be of any length. Extra columns are ignored, or kept by the stage that keeps rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDENTITIES, HOT, HOT_ROWS, arrow_types, cut, freed, hot_keys, identity, importable, joined, map_arrow, table, text_hash, trimmed, without

BLOCK = 4096
_BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, 42)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(whole[a:z], 42) for a, z in zip(starts, ends[shingle - 1 :])], np.uint64)  # noqa: B905
    ones = np.zeros(_BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def _prints(batch: pa.RecordBatch) -> dict:
    out = [fingerprint((b or b"").translate(_LOWER)) for b in batch.column(1).to_pylist()]
    return {"doc_id": batch.column(0), "fp": np.array(out, np.uint64).view(np.int64)}


def fingerprints(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("b")), _prints, f"doc_id {kind}, fp long")


def _moments(batch: pa.RecordBatch) -> dict:
    x = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return {"n": [len(x)], "xx": [(x.T @ x).astype(np.int64).ravel().tolist()]}


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both of any two bits: 64 x 64 sums over all of them."""
    got = map_arrow(distinct.select("fp"), _moments, "n long, xx array<long>").select("n", F.posexplode("xx").alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    xx = np.zeros(_BITS * _BITS)
    for r in got:
        xx[r["i"]] = r["v"]
    return (got[0]["n"] if got else 0), xx.reshape(_BITS, _BITS)


def partitions_of(n: int, xx: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each takes, one after the other, the free bit most correlated with it."""
    p = np.diag(xx) / max(n, 1)
    cov = xx / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    r = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(_BITS)), []
    for k in range(m):
        size = _BITS // m + (k < _BITS % m)
        group = [min(free, key=lambda b: (-round(float(r[b, list(free)].sum()), 9), b))]
        free.discard(group[0])
        while len(group) < size:
            b = min(free, key=lambda b: (-round(float(r[b, group].sum()), 9), b))
            group.append(b)
            free.discard(b)
        out.append(sorted(group))
    return out


def expected_cost(n: int, agree: np.ndarray, bits: list[int], t: int) -> float:
    """Keys plus expected candidate pairs of a partition probed with threshold t."""
    if t < 0:
        return 0.0
    at_most = np.zeros(t + 1)
    at_most[0] = 1.0
    for b in bits:
        at_most[1:] = at_most[1:] * agree[b] + at_most[:-1] * (1 - agree[b])
        at_most[0] *= agree[b]
    return n * comb(len(bits), t) + n * n / 2 * float(at_most.sum())


def allocate(n: int, xx: np.ndarray, distance: int, widest: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition, by dynamic programming over partitions and spent thresholds."""
    p = np.diag(xx) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, widest + 1):
        groups = partitions_of(n, xx, m)
        # with thresholds t, sum of (t + 1) over partitions has to exceed the distance
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            new: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, ts) in state.items():
                for t in range(-1, distance + 1):
                    s = spent + t + 1
                    if s <= distance + 1 and (c := cost + expected_cost(n, agree, g, t)) < new.get(s, (float("inf"),))[0]:
                        new[s] = (c, [*ts, t])
            state = new
        cost, ts = state[distance + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _masks(plan: list[tuple[list[int], int]]) -> np.ndarray:
    return np.array([sum(1 << b for b in g if b not in hole) for g, t in plan for hole in combinations(g, t)], np.uint64)


def _keys(masks: np.ndarray):
    def rows(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy().view(np.uint64)
        v = (fp[:, None] & masks[None, :]).view(np.int64).ravel()
        return {"mask": np.tile(np.arange(len(masks), dtype=np.int32), len(fp)), "v": v, "fp": np.repeat(fp, len(masks)).view(np.int64)}

    return rows


def forest(x: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among x (distinct, sorted). Each round compares one unseen with all unreached."""
    left, out = x, []
    while len(left):
        root, left, queue = left[0], left[1:], []
        queue.append(root)
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(at), int(y)) for y in found]
                queue += list(found)
    return out


def _edges(distance: int, types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(groups: list[np.ndarray]) -> pa.RecordBatch | None:
            out: list[tuple[int, int]] = []
            for x in groups:
                if len(x) == 2:
                    if (int(x[0]) ^ int(x[1])).bit_count() <= distance:
                        out.append((int(x[0]), int(x[1])))
                elif len(x) > 2:
                    out += forest(np.unique(x), distance)
            if not out:
                return None
            e = np.array(out, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0], types[0]), pa.array(e[:, 1], types[1])], ["a", "b"])

        key, held = None, []
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            fp = cols[3].view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            at = np.flatnonzero(new)
            parts = np.split(fp, at[1:])
            keys = [tuple(int(c[i]) for c in cols[:3]) for i in at]
            if keys and keys[0] == key:
                held.append(parts.pop(0))
                keys.pop(0)
            if keys:
                groups = [np.concatenate(held)] if held else []
                held, key = [parts.pop()], keys[-1]
                if (b := solved([g for g in (*groups, *parts) if len(g) > 1])) is not None:
                    yield b
        if held and (b := solved([np.concatenate(held)])) is not None:
            yield b

    return run


def finer(masks: np.ndarray, distance: int) -> np.ndarray:
    """For each mask, distance + 1 masks that also hold a part of the bits outside it: what is within the distance agrees in one of them."""
    out = []
    for m in masks.tolist():
        free = [b for b in range(_BITS) if not m >> b & 1]
        out += [m | sum(1 << b for b in free[i :: distance + 1]) for i in range(distance + 1)]
    return np.array(out, np.uint64)


def _finer_keys(masks: np.ndarray, each: int):
    def rows(batch: pa.RecordBatch) -> dict:
        mask = (batch.column(0).to_numpy().astype(np.int64)[:, None] * each + np.arange(each)).ravel()
        fp = np.repeat(batch.column(1).to_numpy().view(np.uint64), each)
        return {"mask": mask.astype(np.int32), "v": (fp & masks[mask]).view(np.int64), "fp": fp.view(np.int64)}

    return rows


def _marked(keys: DataFrame, hot: DataFrame, total: int) -> DataFrame:
    """keys with the size of their group where it is in hot; the rows of very large groups are salted."""
    most = cut(hot.filter(F.col("size") > max(HOT_ROWS, total // HOT)).select("mask", "v"))
    return joined(keys, hot, ["mask", "v"], "left", most) if most.limit(1).count() else keys.join(hot, ["mask", "v"], "left")


def _large(keys: DataFrame, block: int) -> DataFrame | None:
    hot = cut(keys.groupBy("mask", "v").agg(F.count("*").alias("size")).filter(F.col("size") > block))
    return hot if hot.limit(1).count() else None


def links(distinct: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect what all links within the distance connect.

    Groups of more than `block` fingerprints are split by the bits outside their mask, of which one part in distance + 1
    must agree; what is larger even then is dealt out as pairs of blocks.
    """
    n, xx = bit_statistics(distinct)
    masks = _masks(allocate(n, xx, distance))
    keys = map_arrow(distinct.select("fp"), _keys(masks), "mask int, v long, fp long")
    groups = ["mask", "v", "pair"]
    whole = lambda df: df.select("mask", "v", F.lit(0).cast("long").alias("pair"), "fp")
    parts = whole(keys)
    if (hot := _large(keys, block)) is not None:
        total = n * len(masks)
        marked = _marked(keys, hot, total)
        parts = whole(marked.filter("size IS NULL"))
        fine, base = finer(masks, distance), len(masks)
        split = map_arrow(marked.filter("size IS NOT NULL").select("mask", "fp"), _finer_keys(fine, distance + 1), "mask int, v long, fp long")
        split = split.withColumn("mask", F.col("mask") + base)
        if (hot := _large(split, block)) is not None:
            b = F.pmod(F.xxhash64("fp"), F.col("blocks"))
            split = _marked(split, hot, total).withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("long"))
            split = split.withColumn("own", b).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            parts = parts.union(split.select("mask", "v", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"), "fp"))
        else:
            parts = parts.union(whole(split))
    dealt = parts.repartition(*groups).sortWithinPartitions(*groups)
    importable(distinct.sparkSession)
    return dealt.mapInArrow(trimmed(_edges(distance, arrow_types(distinct.sparkSession, "a long, b long"))), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, by hooking to the smallest neighbour and pointer jumping.

    Joins on a neighbour of very many nodes, or on the root of a large component, salt these keys.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = cut(both)
    hubs = hot_keys(both, ["b"])
    reached = lambda label: joined(both, label, ["b"], "inner", hubs) if hubs is not None else both.join(label, "b")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    label = cut(label)
    while True:
        near = reached(label.select(F.col("node").alias("b"), F.col("root").alias("r"))).groupBy("a").agg(F.min("r").alias("r"))
        new = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("mid"))
        # the old root learns of it too, and every node follows its root's root
        told = new.groupBy(F.col("old").alias("node")).agg(F.min("mid").alias("t"))
        hooked = cut(new.join(told, "node", "left").select("node", "old", F.least("mid", F.coalesce("t", "mid")).alias("root")))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        label2 = cut(joined(hooked, jump, ["root"], "left").select("node", F.coalesce("up", "root").alias("root"), "old"))
        changed = label2.filter("root <> old").limit(1).count()
        label = label2.select("node", "root")
        if not changed:
            return label


def classes(prints: DataFrame, least: Column, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """prints (a table that is already computed) with the smallest value of `least` in the component of each row's fp, as rep."""
    distinct = cut(prints.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("rows")))
    label = components(links(distinct, distance, block))
    named = cut(distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    smallest = named.groupBy("root").agg(F.min("least").alias("rep"))
    to = joined(named.select("fp", "root"), smallest, ["root"]).select("fp", "rep")
    freed(prints.sparkSession)
    n = named.agg(F.sum("rows")).first()[0] or 0
    copies = cut(named.filter(F.col("rows") > max(HOT_ROWS, n // HOT)).select("fp"))
    return joined(prints, to, ["fp"], "inner", copies) if copies.limit(1).count() else prints.join(to, "fp")


def near_duplicates(docs: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links, null only if all are) of every document."""
    return classes(cut(fingerprints(docs)), F.col("doc_id"), distance, block).withColumnRenamed("rep", "component_id")


def one_of_each(docs: DataFrame, distance: int = 3) -> DataFrame:
    """docs, all columns, with one row of each component: the one of smallest doc_id (null last), then of the smallest hash of the text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, fp long"
    prints = cut(map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("b"), text_hash().alias("k")), lambda x: _prints(x) | {"k": x.column(2)}, schema))
    who = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("k").alias("k"))
    judged = classes(prints, who, distance)
    same = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("doc_id").isNull().alias("n"), F.col("k").alias("k"))
    out = without(docs, judged.filter(who != F.col("rep")).select(same.alias("gone")))
    again = cut(prints.groupBy(same.alias("again")).agg(F.count("*").alias("rows")).filter("rows > 1").select("again"))
    if not again.limit(1).count():
        return out
    here = F.broadcast(again) if again.count() <= BROADCAST_IDENTITIES else again
    one = out.join(here, identity(out) == here["again"], "left_semi").groupBy(identity(out).alias("g")).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in out.columns))).alias("r")).select("r.*")
    return out.join(here, identity(out) == here["again"], "left_anti").union(one)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
