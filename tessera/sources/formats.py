"""Formats that Spark reads and writes in ranges: matrices of fixed width, and logs of lines.

register() adds them to a session as `matrix` and `log_lines`. A matrix is a .npy file; a partition reads or writes its own
range of rows, numbered by `position`. When it is written, each range's digest is kept beside the file
(<path>.ranges.json), so a reader checks what it reads and no one needs the whole; the digest of the whole file is there on
demand. A log's partitions are byte ranges; a line belongs to the range that its first byte is in, its `offset`. Paths are
of a file system that the driver and all executors see.

The options low and high bound position and offset, and ranges outside are not read. `matrix_pushed` and `log_lines_pushed`
take the bounds from filters. Spark 4.1 keeps what one plan's filters left for all plans over the same loaded table, so
such a table is to be loaded anew for each filter; the plain ones have no such limit.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.skew import importable, placed

#: Bytes of a partition.
RANGE = 32 << 20


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class Bounds:
    """What filters leave of a range of whole numbers (from `low` on, below `high`)."""

    def __init__(self, column: str, options: dict[str, str], high: int) -> None:
        self.column, self.low, self.high = column, int(options.get("low", 0)), min(high, int(options.get("high", high)))

    def pushed(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """All filters, as a range may hold more rows than they ask for."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.column,):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, f.value + 1)
                elif isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value) + 1)
            yield f


@dataclass
class Range(InputPartition):
    low: int
    high: int
    sha256: str | None = None

    def __init__(self, low: int, high: int, sha256: str | None = None) -> None:
        super().__init__((low, high))
        self.low, self.high, self.sha256 = low, high, sha256


def _header(path: str) -> tuple[int, int, np.dtype, int]:
    """Rows, width, type and the data's first byte of a .npy file."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, columnwise, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        if columnwise or len(shape) != 2 or kind.hasobject:
            raise ValueError(f"{path}: rows of numbers are expected")
        if os.path.getsize(path) != f.tell() + shape[0] * shape[1] * kind.itemsize:
            raise ValueError(f"{path}: {shape[0]} rows are announced, the file is of another length")
        return shape[0], shape[1], kind, f.tell()


class MatrixReader(DataSourceReader):
    """position, v of the rows within the bounds; a range whose digest is kept is read whole and checked."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.columns = local(options["path"]), [f.name for f in schema.fields]
        self.rows, self.width, self.kind, self.data = _header(self.path)
        self.step = max(1, int(options.get("rangeBytes", RANGE)) // max(1, self.width * self.kind.itemsize))
        kept = Path(self.path + ".ranges.json")
        self.ranges = json.loads(kept.read_text())["ranges"] if kept.exists() else None
        self.bounds = Bounds("position", options, self.rows)

    def partitions(self) -> list[Range]:
        known = [Range(r["first"], r["first"] + r["rows"], r["sha256"]) for r in self.ranges] if self.ranges else [Range(a, min(a + self.step, self.rows)) for a in range(0, self.rows, self.step)]
        return [r for r in known if r.high > self.bounds.low and r.low < self.bounds.high]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # filters left no range
            return
        line = self.width * self.kind.itemsize
        digest = hashlib.sha256()
        with open(self.path, "rb") as f:
            f.seek(self.data + partition.low * line)
            step = max(1, (8 << 20) // max(1, line))
            for a in range(partition.low, partition.high, step):
                n = min(step, partition.high - a)
                raw = f.read(n * line)
                digest.update(raw)
                if a + n == partition.high and partition.sha256 not in (None, digest.hexdigest()):
                    raise ValueError(f"{self.path}: rows {partition.low} to {partition.high} are not what was written")
                out = {"position": pa.array(np.arange(a, a + n))}
                if "v" in self.columns:
                    values = pa.array(np.frombuffer(raw, self.kind).astype(np.float32))
                    out["v"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), values)
                rows = pa.RecordBatch.from_arrays([out[c] for c in self.columns], self.columns)
                first, last = max(self.bounds.low, a), min(self.bounds.high, a + n)
                if first < last:
                    yield rows.slice(first - a, last - first)


@dataclass
class Written(WriterCommitMessage):
    ranges: list[tuple[int, int, str]]


class MatrixWriter(DataSourceArrowWriter):
    """Rows (position, v) at their places; positions go from 0 on, and a partition has runs of them."""

    def __init__(self, path: str, rows: int, width: int, kind: np.dtype) -> None:
        self.path, self.rows, self.width, self.kind = path, rows, width, kind
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": kind.str, "fortran_order": False, "shape": (rows, width)})
        self.data = len(head.getvalue())
        with open(path + ".part", "wb") as f:
            f.write(head.getvalue())
            f.truncate(self.data + rows * width * kind.itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        line, out, at, digest, first = self.width * self.kind.itemsize, [], None, hashlib.sha256(), 0
        with open(self.path + ".part", "r+b") as f:
            for batch in iterator:
                places = batch["position"].to_numpy()
                values = batch["v"].flatten().to_numpy(zero_copy_only=False)
                if (batch["v"].value_lengths().to_numpy(zero_copy_only=False) != self.width).any() or not np.isfinite(values).all():
                    raise ValueError("vectors of another width, or that aren't finite")
                m = values.reshape(len(places), self.width).astype(self.kind)
                cuts = [0, *(np.flatnonzero(np.diff(places) != 1) + 1).tolist(), len(places)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if at != places[a]:
                        if at is not None:
                            out.append((first, at - first, digest.hexdigest()))
                        first, digest = int(places[a]), hashlib.sha256()
                        f.seek(self.data + first * line)
                    raw = m[a:b].tobytes()
                    f.write(raw)
                    digest.update(raw)
                    at = int(places[b - 1]) + 1
            if at is not None:
                out.append((first, at - first, digest.hexdigest()))
            f.flush()
            os.fsync(f.fileno())
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        ranges = sorted(r for m in messages if m for r in m.ranges)
        if [a for a, _, _ in ranges] != [sum(n for _, n, _ in ranges[:i]) for i in range(len(ranges))] or sum(n for _, n, _ in ranges) != self.rows:
            raise ValueError("rows are missing or written twice")
        root = hashlib.sha256("\n".join(d for *_, d in ranges).encode()).hexdigest()
        told = {"rows": self.rows, "width": self.width, "root": root, "ranges": [{"first": a, "rows": n, "sha256": d} for a, n, d in ranges]}
        Path(self.path + ".ranges.json.part").write_text(json.dumps(told))
        os.replace(self.path + ".part", self.path)
        os.replace(self.path + ".ranges.json.part", self.path + ".ranges.json")

    def abort(self, messages: list[Written | None]) -> None:
        Path(self.path + ".part").unlink(missing_ok=True)


class MatrixSource(DataSource):
    """Options: path, low, high; rangeBytes for files without kept ranges; to write rows, width and dtype (float16 or float32)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        _header(local(self.options["path"]))
        return "position bigint, v array<float>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        path = local(self.options["path"])
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        return MatrixWriter(path, int(self.options["rows"]), int(self.options["width"]), np.dtype(self.options.get("dtype", "float32")).newbyteorder("<"))


class LinesReader(DataSourceReader):
    """offset, line, whole (it ends with a line's end) of the lines that start within the bounds."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.columns, self.step = local(options["path"]), [f.name for f in schema.fields], int(options.get("rangeBytes", RANGE))
        self.bounds = Bounds("offset", options, os.path.getsize(self.path))

    def partitions(self) -> list[Range]:
        low, high = max(0, self.bounds.low), self.bounds.high
        return [Range(max(a, low), min(a + self.step, high)) for a in range(low // self.step * self.step, high, self.step)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows: dict[str, list] = {"offset": [], "line": [], "whole": []}
        made = lambda: pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in (("offset", pa.int64()), ("line", pa.string()), ("whole", pa.bool_())) if c in self.columns], [c for c in rows if c in self.columns])
        with open(self.path, "rb") as f:
            f.seek(max(0, partition.low - 1))
            if partition.low and f.read(1) != b"\n":
                f.readline()  # it began before
            size = 0
            while (at := f.tell()) < partition.high:
                raw = f.readline()
                for c, v in (("offset", at), ("line", raw.rstrip(b"\r\n").decode("utf-8", "replace")), ("whole", raw.endswith(b"\n"))):
                    rows[c].append(v)
                size += len(raw)
                if size > 4 << 20:
                    yield made()
                    size = 0
                    for c in rows:
                        rows[c].clear()
        if rows["offset"]:
            yield made()


class LinesSource(DataSource):
    """Options: path, low, high, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "offset bigint, line string, whole boolean"

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(schema, self.options)


class PushedMatrixReader(MatrixReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return list(self.bounds.pushed(filters))


class PushedLinesReader(LinesReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return list(self.bounds.pushed(filters))


class PushedMatrixSource(MatrixSource):
    """A matrix that is loaded for one filter."""

    @classmethod
    def name(cls) -> str:
        return "matrix_pushed"

    def reader(self, schema: StructType) -> PushedMatrixReader:
        return PushedMatrixReader(schema, self.options)


class PushedLinesSource(LinesSource):
    """A log that is loaded for one filter."""

    @classmethod
    def name(cls) -> str:
        return "log_lines_pushed"

    def reader(self, schema: StructType) -> PushedLinesReader:
        return PushedLinesReader(schema, self.options)


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MatrixSource, LinesSource, PushedMatrixSource, PushedLinesSource):
        spark.dataSource.register(source)


def write_matrix(rows: DataFrame, path: str, dtype: str = "float32") -> DataFrame:
    """Writes rows (id, v) as a matrix in order of id, each range by its own task; position and id of every row, which are
    kept as <path>.ids, a table."""
    spark = rows.sparkSession
    register(spark)
    ordered = placed(rows.select("id", F.col("v").cast("array<float>").alias("v")), "id", name="position")
    n, width = ordered.count(), ordered.select(F.max(F.size("v"))).first()[0] or 0
    ranged = ordered.select("position", "v").repartitionByRange("position").sortWithinPartitions("position")
    ranged.write.format("matrix").mode("overwrite").option("path", path).option("rows", n).option("width", width).option("dtype", dtype).save()
    ordered.select("position", "id").write.mode("overwrite").parquet(path + ".ids")
    return spark.read.parquet(path + ".ids")


def read_matrix(spark: SparkSession, path: str, pushed: bool = False, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("matrix_pushed" if pushed else "matrix").options(path=path, **options).load()


def read_lines(spark: SparkSession, path: str, pushed: bool = False, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("log_lines_pushed" if pushed else "log_lines").options(path=path, **options).load()


def file_digest(path: str) -> str:
    """The digest of the whole file, on demand."""
    with open(local(path), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
