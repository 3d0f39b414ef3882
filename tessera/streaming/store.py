"""Event-sourced state: revisions, snapshots, undo, replay, receipts, consents and recovery of moves.

Changes are rows of key, batch, inverse_of, revision, position, before, after, before_token, after_token. A null state is
a key that is gone. A batch changes a key at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .events import latest


def current(changes: DataFrame, root: int | None = None) -> DataFrame:
    """key, after, token: the last state of each key up to a revision, gone keys included."""
    d = changes if root is None else changes.filter(F.col("revision") <= root)
    return latest(d, ["key"], ["revision", "position"], ["after", F.col("after_token").alias("token")])


def snapshot(changes: DataFrame, root: int | None = None) -> DataFrame:
    """key, after, token of the keys that stand at a revision."""
    return current(changes, root).filter(F.col("after").isNotNull())


def undo_plan(changes: DataFrame, batch: str) -> DataFrame:
    """key, after, status of each key of a batch: undo to the state before it, a conflict where a later change stands, or done where the batch was undone before.

    Token and state must both be what the batch left, so a key that was changed and changed back isn't undone.
    """
    own = changes.filter(F.col("batch") == batch).select("key", "before", F.col("after").alias("left"), "after_token")
    prior = changes.agg(F.coalesce(F.max(F.col("inverse_of") == batch), F.lit(False)).alias("prior"))
    j = own.join(current(changes), "key").crossJoin(prior)  # prior is one row
    fits = (F.col("token") == F.col("after_token")) & F.col("after").eqNullSafe(F.col("left"))
    status = F.when(F.col("prior"), "done").when(fits, "undo").otherwise("conflict")
    return j.select("key", F.when(status == "undo", F.col("before")).alias("after"), status.alias("status"))


def replay_breaks(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """key, revision, kind: changes that don't follow the one before (token or state), and stored rows (key, after, token) that a replay doesn't give."""
    w = Window.partitionBy("key").orderBy("revision", "position")
    d = changes.withColumn("t", F.lag("after_token").over(w)).withColumn("s", F.lag("after").over(w))
    kind = F.when(~F.col("t").eqNullSafe(F.col("before_token")), "token").when(~F.col("s").eqNullSafe(F.col("before")), "state")
    chain = d.select("key", "revision", kind.alias("kind")).filter(F.col("kind").isNotNull())
    r = snapshot(changes).select("key", F.struct("after", "token").alias("r"))
    j = r.join(stored.select("key", F.struct("after", "token").alias("q")), "key", "full").filter(~F.col("r").eqNullSafe(F.col("q")))
    kind = F.when(F.col("q").isNull(), "missing").when(F.col("r").isNull(), "extra").otherwise("different")
    return chain.unionByName(j.select("key", F.lit(None).cast("long").alias("revision"), kind.alias("kind")))


def actions(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """operation, action, status: cached where the operation's last receipt says completed, else execute.

    requests: action, revision, profile, paths; the operation is a digest of these, whatever the order of its paths.
    receipts: operation, seq, outcome.
    """
    parts = F.concat_ws("\n", "action", F.col("revision").cast("string"), "profile", F.array_join(F.array_sort("paths"), "\n"))
    r = latest(receipts, ["operation"], ["seq"], ["outcome"])
    j = requests.withColumn("operation", F.sha2(parts, 256)).join(r, "operation", "left")
    return j.select("operation", "action", F.when(F.col("outcome") == "completed", "cached").otherwise("execute").alias("status"))


def progress(receipts: DataFrame, outcomes: tuple[str, ...] = ("completed", "cached", "failed", "unavailable")) -> DataFrame:
    """action and how many of its operations last ended in each outcome."""
    r = latest(receipts, ["operation"], ["seq"], ["action", "outcome"])
    return r.groupBy("action").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))


def consents(events: DataFrame) -> DataFrame:
    """root, report, status: the last of prepare, confirm, dismiss and retract; a confirmed report is superseded once a later one of its root is."""
    last = events.groupBy("root", "report").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    newest = last.filter("action = 'confirm'").groupBy("root").agg(F.max("seq").alias("newest"))
    status = F.when((F.col("action") == "confirm") & (F.col("seq") < F.col("newest")), "superseded").otherwise(F.col("action"))
    return last.join(newest, "root", "left").select("root", "report", status.alias("status"))


def outstanding(ledger: DataFrame) -> DataFrame:
    """item, status of the ledger's items (item, seq, status) whose effect still stands."""
    return latest(ledger, ["item"], ["seq"], ["status"]).filter(~F.col("status").isin("undone", "already_undone"))


def move_states(plan: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """src, found, state of each planned move (src, dst, sha) without a record in known (src), by the files (path, sha) that exist.

    The destination is dst or, after a collision, dst with the first 16 or all digits of the content. Both present is kept
    apart from moved, as a torn copy can't be told from a staged one; a source with other content is a conflict.
    """
    # any side may be as long as the plan, and estimates take its digests for short strings, so none is sent to all workers
    todo = plan.filter("dst IS NOT NULL AND dst <> src").join(known.select("src").distinct().hint("merge"), "src", "left_anti")
    stem, suffix = F.regexp_extract("dst", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("dst", r"(\.[^./]*)?$", 1)
    names = F.array("dst", F.concat(stem, F.lit("__"), F.substring("sha", 1, 16), suffix), F.concat(stem, F.lit("__"), "sha", suffix))
    at = todo.select("src", "sha", F.posexplode(names).alias("i", "path")).join(files.hint("merge"), ["path", "sha"]).groupBy("src").agg(F.min_by("path", "i").alias("found"))
    here = files.select(F.col("path").alias("src"), F.col("sha").alias("own"))
    j = todo.join(at.hint("merge"), "src", "left").join(here.hint("merge"), "src", "left")
    state = (
        F.when(F.col("own") != F.col("sha"), "conflict")
        .when(F.col("found").isNull(), F.when(F.col("own").isNull(), "lost").otherwise("source_only"))
        .otherwise(F.when(F.col("own").isNull(), "moved").otherwise("both"))
    )
    return j.select("src", "found", state.alias("state"))


class Revisions:
    """Two-phase batches in a shared folder, without locks.

    A batch is prepared as events/batch=<name>. It is published by the exclusive creation of the next file of log/, which
    names it, so of two writers with the same parent one fails. A claim that a crash left empty is a revision without
    changes. Exclusive creation is atomic on HDFS and local file systems; object stores need one that offers it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("log", "events"):
            self.fs.mkdirs(self.at(f"{path}/{part}"))

    def _names(self, part: str) -> list[str]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self.at(f"{self.path}/{part}")))
        return sorted(n for n in names if n[0] not in "._")

    def root(self) -> int:
        """The last published revision; 0 before the first."""
        return int((self._names("log") or ["0"])[-1])

    def published(self) -> DataFrame:
        """revision, batch."""
        log = self.spark.read.schema("value string").text(f"{self.path}/log")
        return log.select(F.col("_metadata.file_name").cast("long").alias("revision"), F.col("value").alias("batch"))

    def _revision(self, batch: str) -> int | None:
        one = self.published().filter(F.col("batch") == batch).head()
        return one and one.revision

    def prepare(self, changes: DataFrame, batch: str) -> None:
        """Writes a batch that is not yet seen; one batch at a time may be prepared."""
        done = self.spark.createDataFrame([(n[6:],) for n in self._names("events")], "batch string")
        if left := [r.batch for r in done.join(self.published(), "batch", "left_anti").head(1)]:
            raise RuntimeError(f"batch {left[0]} is prepared")
        if self._revision(batch):
            raise RuntimeError(f"batch {batch} is published")
        changes.write.parquet(f"{self.path}/events/batch={batch}")

    def publish(self, batch: str, parent: int) -> int:
        """The batch's revision, which follows parent; a batch that is published keeps its own."""
        if done := self._revision(batch):
            return done
        if not self.fs.exists(self.at(f"{self.path}/events/batch={batch}/_SUCCESS")):
            raise RuntimeError(f"batch {batch} is not prepared")
        if self.root() != parent:
            raise RuntimeError(f"the root is {self.root()}, not {parent}")
        out = self.fs.create(self.at(f"{self.path}/log/{parent + 1:020d}"), False)
        out.write(bytearray(batch.encode()))
        out.close()
        return parent + 1

    def abort(self, batch: str) -> None:
        """Removes a batch that is prepared but not published."""
        if self._revision(batch):
            raise RuntimeError(f"batch {batch} is published")
        self.fs.delete(self.at(f"{self.path}/events/batch={batch}"), True)

    def changes(self) -> DataFrame:
        """The changes of all published batches, with their revision."""
        e = self.spark.read.schema(f"{self.schema}, batch string").parquet(f"{self.path}/events")
        return e.join(self.published(), "batch")
