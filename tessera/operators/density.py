"""Hierarchical density clusters by mutual reachability.

A group of up to SMALL rows is one task. Of a larger one core distances come from the cells of points that can hold a
point's neighbours (metric.py). An edge that isn't in the tree of least mutual reachability of a part of the rows isn't in
that of all, so rows are dealt into blocks, each two blocks give their tree, and trees are united by lots until one is left.
All pairs are so looked at twice, whatever the vectors. Vectors never meet in one task; the clusters come from the tree's
sorted edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .metric import COSINE, SLACK, Kernel, cell_size, celled, units
from .skew import importable, kept

#: Rows of a group that one task clusters.
SMALL = 4096
#: Rows of a block, two of which are compared in a task, and trees that a task unites.
BLOCK, UNITED = 2048, 8


def spanning_tree(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Rows (distance, i, j) of the tree of least mutual reachability, a row counting as its own first neighbour; of equal
    edges that of the smaller rows goes first, so there is one such tree."""
    n = len(x)
    row = lambda i: COSINE.distance(x[i : i + 1], x)[0]
    core = np.array([np.partition(row(i), neighbours - 1)[neighbours - 1] for i in range(n)])
    near, via, out, at, all_rows = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0, np.arange(n)
    edges = np.empty((n - 1, 3))
    for k in range(n - 1):
        out[at] = False
        reach = np.round(np.maximum(np.maximum(core, core[at]), row(at)), 12)
        low, high = np.minimum(all_rows, at), np.maximum(all_rows, at)
        was = np.minimum(all_rows, via)
        before = (low < was) | ((low == was) & (high < np.maximum(all_rows, via)))
        better = out & ((reach < near) | ((reach == near) & before))
        near[better], via[better] = reach[better], at
        ties = np.flatnonzero(out & (near == near[out].min()))
        low, high = np.minimum(ties, via[ties]), np.maximum(ties, via[ties])
        to = int(ties[np.lexsort((high, low))[0]])
        edges[k] = near[to], min(via[to], to), max(via[to], to)
        at = to
    return edges[np.lexsort((edges[:, 2], edges[:, 1], edges[:, 0]))]


def linked(edges: np.ndarray, n: int) -> tuple[list[tuple[int, int]], list[float], list[int]]:
    """The merges of n rows by a tree's edges in order: children, height and size of node n + k. Edges that close a ring are passed over."""
    parent, size = list(range(2 * n - 1)), [1] * (2 * n - 1)
    children, heights = [], []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d, i, j in edges:
        a, b = top(int(i)), top(int(j))
        if a != b:
            node = n + len(children)
            parent[a] = parent[b] = node
            size[node] = size[a] + size[b]
            children.append((a, b))
            heights.append(float(d))
    return children, heights, size


def clusters(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Label (-1: noise) and membership strength of each row, by the clusters of most excess of mass, never the whole."""
    n = len(x)
    if n < max(least, 2):
        return np.full(n, -1), np.zeros(n)
    return condensed(spanning_tree(x, min(least, n)), n, least)


def condensed(edges: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the sorted edges of a tree of n rows."""
    labels, strength = np.full(n, -1), np.zeros(n)
    children, heights, size = linked(edges, n)
    # clusters by number, 0 the whole: birth, parent, and what leaves each: (level, rows), with points apart
    birth, above, mass, last = [0.0], [-1], [0.0], [0.0]
    home, level = np.zeros(n, int), np.zeros(n)

    def points(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            v = todo.pop()
            todo += children[v - n] if v >= n else ()
            found += [v] if v < n else []
        return found

    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        at = 1 / heights[node - n] if heights[node - n] > 0 else np.inf
        big = [ch for ch in children[node - n] if size[ch] >= least]
        for ch in children[node - n]:
            if len(big) == 2:
                birth.append(at)
                above.append(c)
                mass.append(0.0)
                last.append(0.0)
                todo.append((ch, len(birth) - 1))
            elif ch in big:
                todo.append((ch, c))
                continue
            else:
                p = points(ch)
                home[p], level[p] = c, at
            mass[c] += (at - birth[c]) * size[ch] if at > birth[c] else 0.0
            last[c] = max(last[c], at)
    chosen, held = [False] * len(birth), list(mass)
    below: list[list[int]] = [[] for _ in birth]
    for c in range(1, len(birth)):
        below[above[c]].append(c)
    for c in range(len(birth) - 1, 0, -1):
        inner = sum(held[b] for b in below[c])
        if below[c] and inner > held[c]:
            held[c] = inner
        else:
            chosen[c] = True
    owner = [-1] * len(birth)
    for c in range(1, len(birth)):  # a cluster inside a chosen one belongs to it
        owner[c] = owner[above[c]] if owner[above[c]] >= 0 else c if chosen[c] else -1
    for i in range(n):
        if (c := owner[home[i]]) >= 0:
            labels[i] = c
            strength[i] = min(level[i], last[c]) / last[c] if 0 < last[c] < np.inf and level[i] < np.inf else 1.0
    return labels, strength


class _Rows(Kernel):
    """Held rows as arrays, and where each cell's are."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.at: dict[int, list[slice]] = {}
        self.rows = 0
        self.all: pa.Table | None = None

    def hold(self, cell: int, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)
        self.at.setdefault(cell, []).append(slice(self.rows, self.rows + batch.num_rows))
        self.rows += batch.num_rows

    def ready(self) -> None:
        self.all = pa.Table.from_batches(self.parts).combine_chunks()
        self.keys, self.matrix = self.all["k"].combine_chunks(), COSINE.matrix(self.all["v"].combine_chunks())


def _nearest(neighbours: int, key: pa.DataType) -> type[Kernel]:
    class Nearest(_Rows):
        """k, near: each held row's least distances, itself among them."""

        def meet(self, cell: int, held: list[int], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if self.all is None:
                self.ready()
                self.best = np.full((self.rows, neighbours), np.inf)
            at = np.r_[tuple(s for o in held for s in self.at[o])]
            d = np.concatenate([self.best[at], COSINE.distance(self.matrix[at], COSINE.matrix(batch["v"]))], 1)
            self.best[at] = np.partition(d, neighbours - 1, 1)[:, :neighbours]
            yield from ()

        def end(self) -> Iterator[pa.RecordBatch]:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(self.rows + 1, dtype=np.int32) * neighbours), pa.array(self.best.ravel()))
            yield pa.RecordBatch.from_arrays([self.keys.cast(key), lists], ["k", "near"])

    return Nearest


def _tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Rows (distance, i, j) of the tree of least mutual reachability of some rows, given all rows' core distances; of equal
    edges that of the smaller rows goes first."""
    n = len(x)
    reach = np.empty((n, n))
    for at in range(0, n, 256):
        d = np.maximum(COSINE.distance(x[at : at + 256], x), core[at : at + 256, None])
        reach[at : at + 256] = np.round(np.maximum(d, core[None]), 12)
    left = np.arange(1, n)
    near, via = reach[0, 1:].copy(), np.zeros(n - 1, int)
    edges = np.empty((max(n - 1, 0), 3))
    for k in range(n - 1):
        i = int(near.argmin())
        ties = np.flatnonzero(near == near[i])
        if len(ties) > 1:
            a, b = left[ties], via[ties]
            i = int(ties[np.lexsort((np.maximum(a, b), np.minimum(a, b)))[0]])
        to = int(left[i])
        edges[k] = near[i], min(via[i], to), max(via[i], to)
        # the last of those left takes its place
        left[i], near[i], via[i] = left[-1], near[-1], via[-1]
        left, near, via = left[:-1], near[:-1], via[:-1]
        other = reach[to, left]
        same = np.flatnonzero(other == near)
        if len(same):
            a, was = left[same], via[same]
            low, low_was = np.minimum(a, to), np.minimum(a, was)
            same = same[(low < low_was) | ((low == low_was) & (np.maximum(a, to) < np.maximum(a, was)))]
            via[same] = to
        less = other < near
        near[less], via[less] = other[less], to
    return edges


def _united(edges: pa.Table) -> pa.Table:
    """The edges of the least tree (or trees) that can be made of some (a, b, w)."""
    names, codes = np.unique(np.concatenate([edges[c].to_numpy() for c in "ab"]), return_inverse=True)
    a, b = codes[: len(edges)], codes[len(edges) :]
    order = np.lexsort((b, a, edges["w"].to_numpy()))
    parent, taken = list(range(len(names))), []
    for e, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[i] = j
            taken.append(e)
    return edges.take(pa.array(taken, pa.int64()))


def _slices(spark, cells: int, run, schema: str) -> DataFrame:
    """run of each slice of cell numbers, side by side."""
    parts = -(-cells // 256)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["id"].to_pylist():
                yield run(slice(i * 256, min(i * 256 + 256, cells)))

    return spark.range(0, parts, 1, min(parts, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(each, schema)


def tree_edges(points: DataFrame, neighbours: int) -> DataFrame:
    """a, b, w: edges of the tree of least mutual reachability of points (k, once each, and v, unit vectors); a row counts as its own first neighbour."""
    spark, kind = points.sparkSession, dict(points.dtypes)["k"]
    importable(spark)
    key = to_arrow_type(points.schema["k"].dataType)
    points, cells, centres, radii = celled(points, COSINE, True)
    n, size = points.count(), cell_size(points.count(), centres.shape[1])
    sizes = {r["cell"]: r["n"] for r in points.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    numbers = np.array(cells, np.int64)
    sent = spark.sparkContext.broadcast((numbers, centres, radii, np.array([sizes[c] for c in cells])))

    def holding(mine: slice) -> pa.RecordBatch:
        """Cells that may hold the neighbours of each cell's points: those within what it takes to be sure of as many points."""
        numbers, centres, radii, many = sent.value
        d = COSINE.distance(centres[mine], centres)
        most = d + radii[mine, None] + radii[None]
        order = np.argsort(most, 1)
        enough = (np.cumsum(many[order], 1) >= neighbours).argmax(1)
        reach = np.take_along_axis(most, np.take_along_axis(order, enough[:, None], 1), 1)
        i, j = np.nonzero(d - radii[mine, None] - radii[None] <= reach + SLACK)
        return pa.RecordBatch.from_arrays([pa.array(numbers[mine][i]), pa.array(numbers[j])], ["a", "b"])

    pairs = kept(_slices(spark, len(cells), holding, "a long, b long"))
    near = units(points, pairs, size, _nearest(min(neighbours, n), key), f"k {kind}, near array<double>")
    core = near.groupBy("k").agg(F.get(F.sort_array(F.flatten(F.collect_list("near"))), F.lit(min(neighbours, n) - 1)).alias("core"))
    points = points.join(core, "k").select("k", "v", "core")
    blocks = -(-n // BLOCK)
    block = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 2, 0))))
    dealt = points.select("*", block.alias("i"), other.alias("j")).withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("int"))
    dealt = dealt.select("k", "v", "core", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def of_two(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["k"].to_numpy(), kind="stable")))
        edges = _tree(COSINE.matrix(rows["v"].combine_chunks()), rows["core"].to_numpy())
        keys = rows["k"].combine_chunks()
        two = pa.array([rows["i"][0].as_py() * blocks + rows["j"][0].as_py()] * len(edges), pa.int64())
        return pa.table({"a": keys.take(pa.array(edges[:, 1].astype(int))), "b": keys.take(pa.array(edges[:, 2].astype(int))), "w": edges[:, 0], "lot": two})

    schema = f"a {kind}, b {kind}, w double, lot long"
    many = blocks * max(blocks - 1, 1)
    edges = kept(dealt.repartition(max(1, min(many, 16 * spark.sparkContext.defaultParallelism)), "i", "j").groupBy("i", "j").applyInArrow(of_two, schema))
    lots = blocks * blocks
    while lots > 1:
        lots = -(-lots // UNITED)
        edges = kept(edges.withColumn("lot", F.floor(F.col("lot") / UNITED)).groupBy("lot").applyInArrow(_united, schema))
    return edges.select("a", "b", "w")


def density_tree(points: DataFrame, least: int = 5, small: int = SMALL) -> DataFrame:
    """g, k, cluster (its smallest k; null: noise), prob of unit vectors v, in groups g of any size. Groups of over `small`
    rows are taken one after the other, each by all tasks; their last step, linear in the rows, reads the tree's edges."""
    kinds = dict(points.dtypes)
    importable(points.sparkSession)
    schema = f"g {kinds['g']}, k {kinds['k']}, cluster {kinds['k']}, prob double"

    def named(g: object, keys: np.ndarray, label: np.ndarray, prob: np.ndarray) -> pd.DataFrame:
        least_of = pd.Series(keys).groupby(label).min()
        of = pd.Series(label).map(least_of).where(label >= 0).astype("Int64" if kinds["k"] in ("bigint", "int") else object)
        return pd.DataFrame({"g": [g] * len(keys), "k": keys, "cluster": of, "prob": prob})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", ignore_index=True)
        return named(rows["g"].iloc[0], rows["k"].to_numpy(), *clusters(np.array(rows["v"].tolist(), float), least))

    points = kept(points.select("g", "k", "v"))
    large = [r["g"] for r in points.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > small).collect()]
    rest = points
    for g in large:
        rest = rest.filter(~F.col("g").eqNullSafe(F.lit(g)))
    out = rest.groupBy("g").applyInPandas(run, schema)

    def of_tree(g: object):
        def run(edges: pd.DataFrame) -> pd.DataFrame:
            keys = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]))
            e = np.column_stack([edges["w"].to_numpy(), np.searchsorted(keys, edges["a"].to_numpy()), np.searchsorted(keys, edges["b"].to_numpy())])
            # edges of equal length in order of their rows
            return named(g, keys, *condensed(e[np.lexsort((e[:, 2], e[:, 1], e[:, 0]))], len(keys), least))

        return run

    for g in large:
        mine = points.filter(F.col("g").eqNullSafe(F.lit(g))).select("k", "v")
        out = out.union(tree_edges(mine, least).groupBy().applyInPandas(of_tree(g), schema))
    return out
