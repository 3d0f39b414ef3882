"""Helpers that the text operators share: shared-folder checkpoints, Arrow batches, let-bindings."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch sent to a Python worker.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Pairs of longs up to which they are broadcast, and identities of documents.
BROADCAST_IDS, BROADCAST_IDENTITIES = 1_000_000, 200_000
#: A key is hot if it holds more than this part of a table's rows, so there are at most as many hot keys, and at least so many rows.
HOT, HOT_ROWS = 1000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a folder of this machine if the master is this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """A folder of intermediate tables, which goes when the application ends if nothing dropped it before."""
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def drop(*tables: DataFrame) -> None:
    """Deletes tables of saved() that no plan reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, p = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def saved(df: DataFrame) -> DataFrame:
    """Like cut(), as compressed Parquet: for tables of many rows."""
    path = kept_until_exit(df.sparkSession, f"{shared_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer in use."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def identity(docs: DataFrame) -> Column:
    """What tells rows apart by doc_id (null is an id too) and text; rows that repeat share it."""
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("doc_id").isNull().alias("n"), text_hash().alias("k"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose identity is in the column `gone` of ids; up to BROADCAST_IDENTITIES of these are broadcast, more are joined by shuffle."""
    ids = cut(ids.select("gone").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDENTITIES else ids, identity(docs) == ids["gone"], "left_anti")


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys that hold more than 1/HOT of the rows of df (a table that is already computed) and HOT_ROWS: HOT of them at most."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.count()
    least = max(HOT_ROWS, total // HOT)
    if total <= least:
        return None
    hot = cut(counts.filter(F.col("n") > least).select(*keys))
    return hot if hot.limit(1).count() else None


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has a key once. Rows of left's hot keys are dealt over as many salts as there are
    shuffle partitions, and right's rows of these keys are copied to each, so that no task holds a key's rows alone."""
    hot = hot if hot is not None else hot_keys(left, keys)
    if hot is None:
        return left.join(right, keys, how)
    salts = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.lit(salts)).cast("int")).otherwise(0)
    copied = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(hot, keys, "left").withColumn("_salt", dealt).drop("_hot")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(copied)).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def parted(docs: DataFrame, ids: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of docs whose keys are in ids, and the rest; where there are too many ids to broadcast, all of docs and None."""
    if ids.count() > BROADCAST_IDS:
        return docs, None
    ids = F.broadcast(ids.select(*keys))
    return docs.join(ids, keys, "left_semi"), docs.join(ids, keys, "left_anti")


def trimmed(run: Callable[[Iterator], Iterator], after: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run, after whose partition the worker, which Spark keeps, gives its free memory back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if after:
                after()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], dict | None], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """Applies a function from an Arrow batch to a dict of columns; rows are only held batch by batch. after: runs at a partition's end."""
    importable(df.sparkSession)
    for k, v in ARROW.items():
        df.sparkSession.conf.set(k, v)
    names = [f.split()[0].strip("`") for f in _fields(schema)]
    types = arrow_types(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c := out[n], pa.Array) and c.type == t else pa.array(c, t) for n, t in zip(names, types, strict=True)], names)

    return df.mapInArrow(trimmed(run, after), schema)


def _fields(schema: str) -> list[str]:
    """Splits a DDL string at its outer commas."""
    out, depth, cur = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


def arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`; a larger row stands alone."""
    a, n = 0, 0
    for i, s in enumerate(sizes):
        if n and n + s > most:
            yield a, i
            a, n = i, 0
        n += s
    if a < len(sizes):
        yield a, len(sizes)
