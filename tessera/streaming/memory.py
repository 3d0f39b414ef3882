"""Folds of naming events, commands, stages and controls into the state that they leave behind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed barriers of the stage machine.
STAGES = (("IDLE", "INGEST"), ("INGEST", "ANALYZE"), ("ANALYZE", "PROPOSE"), ("PROPOSE", "INGEST"), ("PROPOSE", "CONFIRM"))
FUTURE = ("FIRST_PASS", "REVIEW", "ARCHIVE")


def memory_fold(events: DataFrame) -> DataFrame:
    """face, character, mark: who each face is assigned to, and how it is marked there.

    events: face, seq, action, character, mark. The last event decides: confirm and new assign, anything else takes the
    face from everyone. A mark holds for as long as the face stays with its character; an absent mark keeps it.
    """
    w = Window.partitionBy("face").orderBy("seq")
    d = events.withColumn("on", F.when(F.col("action").isin("confirm", "new"), F.col("character")))
    d = d.withColumn("_new", (~F.col("on").eqNullSafe(F.lag("on").over(w))).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy("face", "_run").agg(F.max("seq").alias("seq"), F.max("on").alias("character"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("seq"))).alias("mark"))
    last = runs.groupBy("face").agg(F.max_by(F.struct("character", "mark"), "seq").alias("l")).select("face", "l.*")
    return last.filter("character IS NOT NULL")


def attribute_profile(memory: DataFrame, attributes: DataFrame) -> DataFrame:
    """character, value, share: each observed value's share of the character's faces that have one. attributes: face, value."""
    n = memory.join(attributes.filter("value IS NOT NULL"), "face").groupBy("character", "value").agg(F.count("*").alias("n"))
    return n.select("character", "value", (F.col("n") / F.sum("n").over(Window.partitionBy("character"))).alias("share"))


def visual_support(memory: DataFrame) -> DataFrame:
    """character, faces: the distinct faces that support it: baseline, variants and assigned ones, in order."""
    return memory.groupBy("character").agg(F.array_sort(F.collect_set("face")).alias("faces"))


def stage_states(events: DataFrame) -> DataFrame:
    """job, seq, stage, status of each requested transition: ok, future-stage or invalid; an invalid one doesn't move the job.

    events: job, seq, stage. A job's transitions depend on each other, so they are folded in order, one job at a time.
    """
    kinds = dict(events.dtypes)
    allowed, future = set(STAGES), set(FUTURE)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, out = "IDLE", []
        for r in rows.sort_values("seq").itertuples():
            status = "future-stage" if r.stage in future else "ok" if (at, r.stage) in allowed else "invalid"
            at = r.stage if status == "ok" else at
            out.append((r.job, r.seq, at, status))
        return pd.DataFrame(out, columns=["job", "seq", "stage", "status"])

    return events.select("job", "seq", "stage").groupBy("job").applyInPandas(run, f"job {kinds['job']}, seq {kinds['seq']}, stage string, status string")


def run_controls(beats: DataFrame, controls: DataFrame, now, stall: int = 60) -> DataFrame:
    """run, status: cancelled and finished for good, paused until resumed, stalled after `stall` seconds without a beat, else running.

    beats: run, ts; controls: run, seq, control (pause, resume, cancel, finish).
    """
    last = beats.groupBy("run").agg(F.max("ts").alias("ts"))
    c = controls.groupBy("run").agg(F.bool_or(F.col("control") == "cancel").alias("cancelled"), F.bool_or(F.col("control") == "finish").alias("finished"), F.max_by("control", F.when(F.col("control").isin("pause", "resume"), F.col("seq"))).alias("last"))
    j = last.join(c, "run", "left")
    old = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts") > stall
    return j.select("run", F.when(F.col("cancelled"), "cancelled").when(F.col("finished"), "finished").when(F.col("last") == "pause", "paused").when(old, "stalled").otherwise("running").alias("status"))


def sealed_receipts(receipts: DataFrame, seals: DataFrame) -> DataFrame:
    """receipts (revision, operation, outcome) as they are replayed: a completed one of a sealed revision is cached."""
    s = seals.select("revision").distinct().withColumn("sealed", F.lit(True))
    done = F.col("sealed") & F.col("outcome").isin("completed", "cached")
    return receipts.join(s, "revision", "left").select("revision", "operation", F.when(done, "cached").otherwise(F.col("outcome")).alias("outcome"), F.coalesce("sealed", F.lit(False)).alias("sealed"))


def tray_fold(commands: DataFrame, images: DataFrame) -> DataFrame:
    """image, archived, disposition, triggers after all commands; refused counts those that need a subject to be named.

    commands: image, seq, action (archive, reopen, defer, unknown-foreign, notify), trigger; images: image, subjects
    (their number), disposition. Archiving hides nothing else; a trigger is noted once.
    """
    moves = {"reopen": "pending", "defer": "deferred", "unknown-foreign": "unknown-foreign"}
    j = commands.join(images, "image")
    to = F.coalesce(*(F.when(F.col("action") == k, F.lit(v)) for k, v in moves.items()))
    whole = F.col("subjects") == 0
    g = j.groupBy("image").agg(
        F.bool_or(F.col("action") == "archive").alias("archived"), F.max_by(to, F.when(to.isNotNull() & whole, F.col("seq"))).alias("moved"),
        F.array_sort(F.collect_set(F.when(F.col("action") == "notify", F.col("trigger")))).alias("triggers"), F.count_if(to.isNotNull() & ~whole).alias("refused"),
    )
    r = images.join(g, "image", "left")
    return r.select("image", F.coalesce("archived", F.lit(False)).alias("archived"), F.coalesce("moved", "disposition").alias("disposition"), F.coalesce("triggers", F.array().cast(dict(g.dtypes)["triggers"])).alias("triggers"), F.coalesce("refused", F.lit(0)).alias("refused"))


def cache_states(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (content, namespace) with hit, stale (same content, other namespace), corrupt (the payload isn't its digest) or miss.

    entries: content, namespace, payload, digest; a changed content is another content, so it can't be hit.
    """
    e = entries.select("content", "namespace", (F.sha2("payload", 256) == F.col("digest")).alias("_good")).groupBy("content", "namespace").agg(F.bool_or("_good").alias("_good"))
    other = entries.select("content").distinct().withColumn("_other", F.lit(True))
    j = requests.join(e, ["content", "namespace"], "left").join(other, "content", "left")
    return j.select(*requests.columns, F.when(F.col("_good"), "hit").when(~F.col("_good"), "corrupt").when(F.col("_other"), "stale").otherwise("miss").alias("state"))


def replay_journal(journal: DataFrame) -> DataFrame:
    """journal, face, name, mark after a browser's journal: an import starts anew, names are renamed, merged and deleted, faces marked.

    journal: journal, seq, action (import, rename, merge, delete, mark, clear), name, target, face, mark. Each journal is
    one person's and is replayed in order in one task; any number of them run side by side.
    """
    kinds = dict(journal.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of: dict[object, tuple[str, str | None]] = {}
        for r in rows.sort_values("seq").itertuples():
            if r.action == "import":
                of = {}
            elif r.action in ("rename", "merge"):
                of = {f: (r.target if n == r.name else n, m) for f, (n, m) in of.items()}
            elif r.action == "delete":
                of = {f: x for f, x in of.items() if x[0] != r.name}
            elif r.action == "clear":
                of.pop(r.face, None)
            elif r.action == "mark":
                before = of.get(r.face)
                of[r.face] = (r.name, r.mark if r.mark is not None else before[1] if before and before[0] == r.name else None)
        return pd.DataFrame([(rows["journal"].iloc[0], f, n, m) for f, (n, m) in of.items()], columns=["journal", "face", "name", "mark"])

    return journal.groupBy("journal").applyInPandas(run, f"journal {kinds['journal']}, face {kinds['face']}, name string, mark string")


def migrations(applied: DataFrame, known: Iterator[tuple[int, str]]) -> list[tuple[int, str]]:
    """The steps (version, digest) still to apply; a gap, an unknown version or a digest that isn't the known one fails."""
    steps = dict(known)
    done = {r["version"]: r["digest"] for r in applied.collect()}  # a row for each step
    for i, v in enumerate(sorted(done), 1):
        if v != i or steps.get(v) != done[v]:
            raise ValueError(f"version {v} of the ledger isn't the known step")
    return [(v, steps[v]) for v in sorted(steps) if v not in done]
