"""Ingestion of files in small batches that are committed by content, frozen revisions, and decisions that run as previewed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import fingerprint
from ..sources.sinks import add_new


def ingest(spark: SparkSession, source: str, results: str, checkpoint: str, inspect: Callable[[DataFrame], DataFrame], files: int = 64) -> None:
    """Works through all new files below source, `files` at a time: each batch's rows (with a sha256) are added unless their content is there."""
    d = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).load(source)

    def commit(batch: DataFrame, _: int) -> None:
        rows = inspect(batch).persist()
        if rows.limit(1).count():
            add_new(rows, results, "sha256")
        rows.unpersist()

    d.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot(files: DataFrame, most: int | None = None) -> DataFrame:
    """path, sha256, status of files (path, content; null content: it couldn't be read), the first `most` by path: indexed for
    the first of a content, duplicate for the others, unavailable."""
    d = files.select("path", F.sha2("content", 256).alias("sha256"))
    d = d if most is None else d.orderBy("path").limit(most)
    first = d.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("path").alias("_first"))
    j = d.join(first, "sha256", "left")
    return j.select("path", "sha256", F.when(F.col("sha256").isNull(), "unavailable").when(F.col("path") == F.col("_first"), "indexed").otherwise("duplicate").alias("status"))


def revision(rows: DataFrame, profile: str) -> str:
    """The digest of a profile and of all (path, sha256, status) by path, as one compact JSON array; rows pass the driver one partition after the other."""
    digest, n = hashlib.sha256(b"[" + json.dumps(profile).encode() + b",["), 0
    for r in rows.select("path", "sha256", "status").sort("path").toLocalIterator(True):
        digest.update(b"," * (n > 0) + json.dumps([r["path"], r["sha256"], r["status"]], separators=(",", ":")).encode())
        n += 1
    digest.update(b"]]")
    return digest.hexdigest()


def freeze(rows: DataFrame, prior: DataFrame | None, profile: str) -> tuple[str, DataFrame]:
    """(revision, inventory): the snapshot with change (added, changed, same), and what the prior inventory had and is gone,
    carried as unavailable."""
    if prior is None:
        return revision(rows, profile), rows.withColumn("change", F.lit("added"))
    old = prior.filter("status <> 'unavailable'").select("path", F.col("sha256").alias("_old"), F.lit(True).alias("_there"))
    j = rows.withColumn("_here", F.lit(True)).join(old, "path", "full")
    change = F.when(F.col("_here").isNull(), "removed").when(F.col("_there").isNull(), "added").when(~F.col("sha256").eqNullSafe(F.col("_old")), "changed").otherwise("same")
    return revision(rows, profile), j.select("path", F.coalesce("sha256", "_old").alias("sha256"), F.when(F.col("_here").isNull(), "unavailable").otherwise(F.col("status")).alias("status"), change.alias("change"))


def mutated(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """path of frozen members that are gone or whose content isn't the frozen one; new files wait for the next revision."""
    now = files.select("path", F.sha2("content", 256).alias("_now"))
    j = inventory.filter("status <> 'unavailable' AND sha256 IS NOT NULL").join(now, "path", "left")
    return j.filter(~F.col("sha256").eqNullSafe(F.col("_now"))).select("path")


def preview(decisions: DataFrame) -> str:
    """The digest of all decisions, whatever their order."""
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(decisions.columns))), {"ignoreNullFields": "false"})
    return fingerprint(decisions.select(line.alias("l")), "l")[1]


def execute(decisions: DataFrame, previewed: str, path: str) -> DataFrame:
    """Writes the decisions if they are the ones that were previewed; a run that is there is read, not repeated."""
    if preview(decisions) != previewed:
        raise ValueError("the decisions aren't those that were previewed")
    decisions.write.mode("ignore").parquet(path)
    return decisions.sparkSession.read.parquet(path)
