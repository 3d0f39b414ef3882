"""Tables that are kept in the shared folder, joins that survive hot keys, and places in a total order."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of the rows, so there are at most as many, and at least so many rows;
#: a table of fewer rows than a task easily reads has none.
HOT, HOT_ROWS = 1000, 50_000


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one if the master is this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def kept(df: DataFrame) -> DataFrame:
    """Computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left (a table that is kept) joined with right, which has a key once; rows of left's hot keys are dealt over salts."""
    total = left.count()
    least = max(HOT_ROWS, total // HOT)
    if total <= least:
        return left.join(right, keys, how)
    hot = kept(left.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > least).select(*keys))
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    salts = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # HOT rows at most
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.lit(salts)).cast("int")).otherwise(0)
    copied = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(hot, keys, "left").withColumn("_salt", dealt).drop("_hot")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(copied)).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def _placed(df: DataFrame, order: tuple, name: str) -> tuple[DataFrame, int]:
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    d = kept(d.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m"))
    sizes = d.groupBy("_p").agg(F.count("*").alias("n")).collect()  # a row for each partition
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["_p"]):
        starts.append((r["_p"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _o long")
    return d.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o"), before


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """df with each row's place (from 0) in a total order: ranges are sorted side by side, and their sizes are added up."""
    return _placed(df, order, name)[0]


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles by name, exact, null where there are no values; no task holds them all."""
    d, total = _placed(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), ("v",), "place")
    at = {n: p * (total - 1) for n, p in shares.items()}
    wanted = sorted({int(x) + i for x in at.values() for i in (0, 1)})
    v = lambda i: F.max(F.when(F.col("place") == i, F.col("v")))
    out = {}
    for n, x in at.items():
        low, part = int(x), x - int(x)
        out[n] = v(low) if not part else v(low) + (v(low + 1) - v(low)) * F.lit(part)
    return d.filter(F.col("place").isin(wanted)).agg(*(c.alias(n) for n, c in out.items()))


def placed_within(df: DataFrame, keys: list[str], *order: str | Column, name: str = "place") -> DataFrame:
    """df with each row's place (from 0) within its key, which must not be null, and the key's rows as n: a row number for keys of any size."""
    d, total = _placed(df, (*keys, *order), "_at")
    sizes = d.groupBy(*keys).agg(F.min("_at").alias("_start"), F.count("*").alias("n"))
    return (joined if total > HOT_ROWS else DataFrame.join)(d, sizes, keys).withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_start")


def group_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """keys and linearly interpolated quantiles by name of the values that are not null, exact for groups of any size."""
    d = placed_within(df.select(*keys, F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), keys, "v")
    out = {}
    for name, p in shares.items():
        x = F.lit(p) * (F.col("n") - 1)
        at = lambda i, x=x: F.max(F.when(F.col("place") == F.floor(x) + i, F.col("v")))
        out[name] = at(0) + F.coalesce(at(1) - at(0), F.lit(0.0)) * F.max(x - F.floor(x))
    return d.groupBy(*keys).agg(*(v.alias(k) for k, v in out.items()))
