"""Exact joins within a distance: only cells of points that can meet are multiplied.

Pivots, rows of a bounded sample that are far from each other, put the points in an order in which near points are near:
by nearest pivot, the next two nearest, and distance. Runs of this order, cut where the nearest pivot changes and after
CELL points (more, where the cells' centres would outgrow BROADCAST), are the cells, so none is larger, however many
points lie together. A cell is told by its centre and radius: by the triangle inequality no point of one is within r of a
point of another if their centres are further apart than r and both radii. Such cells are never brought together. Which
pivots are taken changes the work and never the result.

Cells that can meet are dealt into units: cells of up to HELD points are held, and cells of up to PASSING points pass by
them batch by batch, so that a task's memory doesn't grow with the table, and only cells that a unit lists are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .skew import importable, kept, placed

#: Points in a cell, that a task holds and that pass by them, pivots, rows from which these are taken, and points up to
#: which all are one cell.
CELL, HELD, PASSING, PIVOTS, SAMPLE, SMALL = 128, 8192, 1 << 16, 1024, 4096, 4096
#: Bytes of the cells' centres, which are broadcast.
BROADCAST = 64 << 20
#: What rounding may add to a distance.
SLACK = 1e-6


class Metric(NamedTuple):
    """matrix: a column's values as rows of numbers; centre of rows; distance and weight (what is told of a pair) of all
    pairs of rows."""

    matrix: Callable[[pa.Array], np.ndarray]
    centre: Callable[[np.ndarray], np.ndarray]
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray]
    weight: Callable[[np.ndarray, np.ndarray], np.ndarray]
    kind: str


def _flat(values: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def _bits(values: pa.Array) -> np.ndarray:
    """Hex strings of one length as numbers of 64 bits."""
    return np.frombuffer(bytes.fromhex("".join(h.rjust(-(-len(h) // 16) * 16, "0") for h in values.to_pylist())), ">u8").astype(np.uint64).reshape(len(values), -1)


def _differing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(p[:, i, None] ^ q[None, :, i]).astype(np.int64) for i in range(p.shape[1]))


def _chords(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows; what rounding leaves of none is none."""
    squares = (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (p @ q.T)
    return np.sqrt(np.where(squares > 1e-14, squares, 0))


def _majority(p: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(p.astype(">u8").view(np.uint8), axis=1).sum(0) * 2 > len(p)
    return np.packbits(bits).view(">u8").astype(np.uint64)


#: Unit vectors by their chord, which falls with the cosine that is told; hex strings by differing bits.
COSINE = Metric(_flat, lambda p: p.mean(0), _chords, lambda p, q: p @ q.T, "double")
HAMMING = Metric(_bits, _majority, _differing, _differing, "long")


def _pivots(points: DataFrame, metric: Metric, most: int) -> np.ndarray:
    """Rows far from each other, out of a sample in order of a hash of the keys; as many as fill cells where cells of a few
    points would cost more than they spare."""
    rows = points.select("v", F.xxhash64("k").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    m = metric.matrix(rows["v"].combine_chunks())
    at, near = [0], metric.distance(m, m[:1])[:, 0].astype(float)
    while len(at) < min(PIVOTS, len(m), most) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, metric.distance(m, m[at[-1:]])[:, 0])
    return m[at]


def celled(points: DataFrame, metric: Metric, full: bool = False) -> tuple[DataFrame, list[int], np.ndarray, np.ndarray]:
    """points (k, v) with their cell, in the order of whose numbers near cells are near, and the cells' numbers, centres and radii."""
    spark = points.sparkSession
    importable(spark)
    n = points.count()
    pivots = _pivots(points, metric, -(-n // CELL) if full else PIVOTS)
    sent = spark.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def near(values: pa.Array) -> pa.Array:
        d = metric.distance(metric.matrix(values), sent.value).astype(float)
        some = min(3, d.shape[1])
        first = np.argpartition(d, some - 1, 1)[:, :some] if some else d
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(d, first, 1), 1, kind="stable"), 1)
        first = np.pad(first, ((0, 0), (0, 3 - some)))
        return pa.StructArray.from_arrays([*(pa.array(first[:, i].astype(np.int64)) for i in range(3)), pa.array(d.min(1))], ["a", "b", "c", "d"])

    d = points.select("k", "v", F.arrow_udf(near, "struct<a:bigint,b:bigint,c:bigint,d:double>")("v").alias("at"))
    d = placed(d, "at.a", "at.b", "at.c", "at.d", "k")
    size = cell_size(n, pivots.shape[1])
    d = kept(d.select("k", "v", (F.floor(F.col("place") / size) * PIVOTS + F.col("at.a")).alias("cell")))

    def told(t: pa.Table) -> pa.Table:
        m = metric.matrix(t["v"].combine_chunks())
        c = metric.centre(m)
        return pa.table({"cell": t["cell"][:1], "centre": [c.astype(c.dtype.newbyteorder("<")).tobytes()], "radius": [float(metric.distance(m, c[None]).max())]})

    balls = d.groupBy("cell").applyInArrow(told, "cell long, centre binary, radius double").orderBy("cell").toArrow()
    centres = np.frombuffer(b"".join(balls["centre"].to_pylist()), pivots.dtype).reshape(len(balls), -1)
    return d, balls["cell"].to_pylist(), centres, balls["radius"].to_numpy()


def meeting_cells(spark: SparkSession, metric: Metric, cells: list[int], centres: np.ndarray, radii: np.ndarray, within: float) -> DataFrame:
    """a, b: cells a <= b (a cell meets itself) that may hold points within the distance of each other."""
    sent = spark.sparkContext.broadcast((np.array(cells, np.int64), centres, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres, radii = sent.value
        for batch in batches:
            for at in batch["id"].to_pylist():
                mine = slice(at * 256, at * 256 + 256)
                near = metric.distance(centres[mine], centres[at * 256 :]) <= radii[mine, None] + radii[None, at * 256 :] + within + SLACK
                i, j = np.nonzero(np.triu(near))
                yield pa.RecordBatch.from_arrays([pa.array(cells[i + at * 256]), pa.array(cells[j + at * 256])], ["a", "b"])

    parts = -(-len(cells) // 256)
    return spark.range(0, parts, 1, min(parts, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "a long, b long")


class Kernel:
    """What a task does with a unit: hold() cells, let others meet() them, and end(). Batches have the points' columns."""

    def hold(self, cell: int, batch: pa.RecordBatch) -> None:
        raise NotImplementedError

    def meet(self, cell: int, held: list[int], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _unit(kernel: Callable[[], Kernel]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come unit by unit: first what is held (side 0), then what passes by, each with the cells it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, now = None, None
        for batch in batches:
            units, sides, cells = (batch[c].to_numpy(zero_copy_only=False) for c in ("unit", "side", "cell"))
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(sides) != 0) | (np.diff(cells) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)], strict=True):
                if a == b:
                    continue
                if units[a] != unit:
                    if now:
                        yield from now.end()
                    unit, now = units[a], kernel()
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    now.hold(int(cells[a]), part)
                else:
                    yield from now.meet(int(cells[a]), part["meets"][0].as_py(), part)
        if now:
            yield from now.end()

    return run


def units(points: DataFrame, pairs: DataFrame, size: int, kernel: Callable[[], Kernel], schema: str) -> DataFrame:
    """What a kernel makes of points (with their cell), where cells a are held and the cells b of pairs (a, b) pass by them."""
    spark = points.sparkSession
    importable(spark)
    unit = (F.floor(F.col("a") / PIVOTS / max(1, HELD // size)) * F.lit(1 << 31) + F.floor(F.col("b") / PIVOTS / max(1, PASSING // size))).alias("unit")
    held = pairs.select(unit, F.col("a").alias("cell")).distinct().select("unit", F.lit(0).alias("side"), "cell", F.array().cast("array<bigint>").alias("meets"))
    by = pairs.groupBy(unit, F.col("b").alias("cell")).agg(F.collect_list("a").alias("meets"))  # of HELD points at most
    rows = held.union(by.select("unit", F.lit(1), "cell", "meets")).join(points, "cell")
    # units take long for their bytes, so partitions aren't put together by size
    many = max(1, min(pairs.select(unit).distinct().count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)))
    rows = rows.repartition(many, "unit").sortWithinPartitions("unit", "side", "cell").select("unit", "side", "cell", "meets", *[c for c in points.columns if c != "cell"])
    return rows.mapInArrow(_unit(kernel), schema)


def cell_size(points: int, width: int) -> int:
    """Points in a cell, so that the centres of all fit BROADCAST."""
    return max(CELL, -(-points * width * 8 // BROADCAST))


def _pairs(metric: Metric, passes: Callable[[np.ndarray], np.ndarray], key: pa.DataType, weight: pa.DataType) -> type[Kernel]:
    class Pairs(Kernel):
        """Pairs a < b whose weight passes."""

        def __init__(self) -> None:
            self.held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def hold(self, cell: int, batch: pa.RecordBatch) -> None:
            self.held.setdefault(cell, []).append((batch["k"], metric.matrix(batch["v"])))

        def meet(self, cell: int, held: list[int], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            k, m = batch["k"], metric.matrix(batch["v"])
            keys = pa.concat_arrays([x for o in held for x, _ in self.held[o]])
            rows = np.concatenate([x for o in held for _, x in self.held[o]])
            same = np.repeat([o == cell for o in held], [sum(len(x) for x, _ in self.held[o]) for o in held])
            for at in range(0, len(rows), 2048):
                w = metric.weight(rows[at : at + 2048], m)
                i, j = np.nonzero(passes(w))
                p, q = keys.take(pa.array(i + at)), k.take(pa.array(j))
                less = pc.less(p, q)
                pairs = [pc.if_else(less, p, q).cast(key), pc.if_else(less, q, p).cast(key), pa.array(w[i, j]).cast(weight)]
                yield pa.RecordBatch.from_arrays(pairs, ["a", "b", "w"]).filter(pc.or_(less, pa.array(~same[i + at])))

    return Pairs


def near_pairs(points: DataFrame, metric: Metric, within: float, passes: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """a, b, w of keys a < b of points (k, once each, and v) whose weight passes; all pairs that pass are within the distance."""
    points = kept(points.select("k", "v"))
    spark, n, kind, size = points.sparkSession, points.count(), dict(points.dtypes)["k"], CELL
    if n <= SMALL:
        points = points.withColumn("cell", F.lit(0).cast("long"))
        pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    else:
        points, cells, centres, radii = celled(points, metric)
        pairs, size = kept(meeting_cells(spark, metric, cells, centres, radii, within)), cell_size(n, centres.shape[1])
    types = (to_arrow_type(points.schema["k"].dataType), pa.int64() if metric.kind == "long" else pa.float64())
    return units(points, pairs, size, _pairs(metric, passes, *types), f"a {kind}, b {kind}, w {metric.kind}")


def similar_pairs(points: DataFrame, least: float) -> DataFrame:
    """a, b, w: keys a < b of unit vectors (k, v) whose cosine w is at least `least`."""
    return near_pairs(points, COSINE, float(np.sqrt(max(0.0, 2 - 2 * least))), lambda w: w >= least)


def hamming_pairs(points: DataFrame, within: int) -> DataFrame:
    """a, b, w: keys a < b of hex strings of one length (k, v) that differ in w bits, `within` at most. For distances so
    wide that bands (neardup.banded_pairs) would be too short to tell rows apart."""
    return near_pairs(points, HAMMING, within, lambda w: w <= within)
