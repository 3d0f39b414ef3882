"""Event logs: folds to current state, chains, undo, and the same folds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last event of each key, by one aggregate that is combined before the shuffle."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("e")).select(*key, "e.*")


def naming_fold(events: DataFrame) -> DataFrame:
    """k, name, excluded: confirm and new set a name and take back an exclusion; ignore and wrong_box remove and exclude."""
    last = latest(events, ["k"], ["seq"], ["action", "name"])
    named = F.col("action").isin("confirm", "new")
    return last.select("k", F.when(named, F.col("name")).alias("name"), (~named).alias("excluded"))


def chain_breaks(log: DataFrame, stream: str, seq: str, digest: str, previous: str) -> DataFrame:
    """Records whose sequence has a gap or whose previous digest isn't the one before."""
    w = Window.partitionBy(stream).orderBy(seq)
    d = log.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag(digest, 1, "").over(w))
    return d.filter((F.col("_n") != F.col(seq)) | ~F.col("_p").eqNullSafe(F.col(previous))).drop("_n", "_p")


def gaps(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Each silence of more than the given seconds between two events of a key."""
    w = Window.partitionBy(key).orderBy(ts, "seq")
    d = events.withColumn("before", F.lag(ts).over(w))
    d = d.withColumn("gap", F.unix_timestamp(ts) - F.unix_timestamp("before"))
    return d.filter(F.col("gap") > seconds)


def undone(events: DataFrame) -> DataFrame:
    """The last action of each key that no later undo takes back; an undo takes back the latest standing one. events: k, seq, action."""
    w = Window.partitionBy("k").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # read backwards, a standing action is one that is reached with no undo open
    step = F.when(F.col("action") == "undo", 1).otherwise(-1)
    d = events.withColumn("open", F.sum(step).over(w)).withColumn("low", F.min("open").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    stands = d.filter((F.col("action") != "undo") & (F.col("open") < F.least(F.coalesce("low", F.lit(0)), F.lit(0))))
    return stands.groupBy("k").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def stream_latest(events: DataFrame, key: str, seq: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Streaming counterpart of latest(): counts and last sequence of each key and hour, with late data bounded by a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), key).agg(F.count("*").alias("n"), F.max(seq).alias("last"))
