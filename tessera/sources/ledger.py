"""Logs whose records are chained by digests, in segments that are written and verified side by side.

A record's digest covers the digest before it and its own text; a segment's first record follows a seed that the
segment's number gives, so segments need nothing of each other. What joins them is the chain of heads: a head covers the
head before it, its segment's last digest and its number of records. A batch of records is written first, and counts from
the moment when the file of heads is replaced by one that lists its segments, so a crash leaves either the old log or the
new one; what a batch left behind without that is torn and set aside. Heads are one row for each SEGMENT records; no
record passes through the driver.

Payloads may be of any length and may repeat; a null payload counts as an empty one. An empty batch changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import importable, kept, placed

#: Records in a segment.
SEGMENT = 100_000


def _seed(segment: int) -> str:
    return hashlib.sha256(f"segment:{segment}".encode()).hexdigest()


def _next(before: str, payload: str | None) -> str:
    return hashlib.sha256(f"{before}\n{payload or ''}".encode()).hexdigest()


def head_of(before: str, tail: str, records: int) -> str:
    return hashlib.sha256(f"{before}\n{tail}\n{records}".encode()).hexdigest()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, sequence, payload) that come in order, with their digests."""
    segment, last = None, ""
    for batch in batches:
        out = []
        for s, payload in zip(batch["segment"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            if s != segment:
                segment, last = s, _seed(s)
            last = _next(last, payload)
            out.append(last)
        yield pa.RecordBatch.from_arrays([batch["segment"], batch["sequence"], batch["payload"], pa.array(out, pa.string())], ["segment", "sequence", "payload", "digest"])


class Files:
    """Small files and folders where Spark's tables are, in any file system it reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def names(self) -> list[str]:
        fs, path = self._at("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        source = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def write(self, name: str, text: str) -> None:
        """A new file, synced; an existing one is an error."""
        fs, path = self._at(name)
        sink = fs.create(path, False)
        sink.write(bytearray(text.encode()))
        sink.hsync()
        sink.close()

    def rename(self, name: str, to: str) -> None:
        fs, path = self._at(name)
        if not fs.rename(path, self._at(to)[1]):
            raise OSError(f"{name} could not be renamed")


class Ledger:
    """A chained log in a folder that all executors see; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, segment: int = SEGMENT) -> None:
        self.spark, self.segment, self.files = spark, segment, Files(spark, root)

    def heads(self) -> list[dict]:
        """number, batch, records, tail and head of each segment that counts: the last list of heads that was written whole."""
        lists = [n for n in self.files.names() if n.startswith("heads-") and n.endswith(".json")]
        return json.loads(self.files.read(lists[-1])) if lists else []

    def append(self, rows: DataFrame, payload: str, *order: str) -> int:
        """Adds rows in the order of the given columns, each as the text of a column; how many they were."""
        importable(self.spark)
        heads = self.heads()
        first, before = len(heads), sum(h["records"] for h in heads)
        keyed = rows.select(F.col(payload).cast("string").alias("payload"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(order)))
        ordered = placed(keyed, *(f"_{i}" for i in range(len(order))), "payload")
        dealt = ordered.select((F.floor(F.col("place") / self.segment) + first).alias("segment"), (F.col("place") + before + 1).alias("sequence"), "payload")
        batch = f"batch-{len(heads):08}-{uuid.uuid4().hex}"
        made = dealt.repartition("segment").sortWithinPartitions("segment", "sequence").mapInArrow(_chained, "segment long, sequence long, payload string, digest string")
        made.write.parquet(f"{self.files.root}/{batch}")
        tails = self.spark.read.schema(made.schema).parquet(f"{self.files.root}/{batch}").groupBy("segment").agg(F.max_by("digest", "sequence").alias("tail"), F.count("*").alias("n")).orderBy("segment").collect()  # a row for each segment
        if not tails:
            return 0
        for r in tails:
            heads.append({"number": r["segment"], "batch": batch, "records": r["n"], "tail": r["tail"], "head": head_of(heads[-1]["head"] if heads else "", r["tail"], r["n"])})
        self._publish(heads)
        return sum(r["n"] for r in tails)

    def _publish(self, heads: list[dict]) -> None:
        """A list of heads counts when it has its name; two writers can't give the same one."""
        name = f"heads-{len(heads):012}"
        beside = f".{name}-{uuid.uuid4().hex}"
        self.files.write(beside, json.dumps(heads))
        if f"{name}.json" in self.files.names():
            raise RuntimeError("another writer was faster")
        self.files.rename(beside, f"{name}.json")

    def records(self) -> DataFrame:
        """segment, sequence, payload, digest of all records that count."""
        batches = sorted({h["batch"] for h in self.heads()})
        schema = "segment long, sequence long, payload string, digest string"
        return self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{b}" for b in batches)) if batches else self.spark.createDataFrame([], schema)

    def faults(self) -> DataFrame:
        """segment, sequence, fault of all that is wrong; empty for a whole log. Segments are verified side by side; of each
        the first broken record is told, and heads are compared with the chain of heads."""
        importable(self.spark)
        heads, before = self.heads(), ""
        known, first = [], 1
        for i, h in enumerate(heads):
            before = head_of(before, h["tail"], h["records"])
            known.append((h["number"], h["tail"], h["records"], first, "head" if h["number"] != i or h["head"] != before else None))
            first += h["records"]
        said = self.spark.createDataFrame(known, "segment long, tail string, n long, first long, fault string")

        def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segment, last, wrong, rows, least, at = None, "", None, 0, None, 0
            done = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((segment, last, rows, least, wrong), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["segment", "found_tail", "found", "least", "wrong"])
            for batch in batches:
                for s, n, payload, digest in zip(*(batch[c].to_pylist() for c in ("segment", "sequence", "payload", "digest")), strict=True):
                    if s != segment:
                        if segment is not None:
                            yield done()
                        segment, last, wrong, rows, least, at = s, _seed(s), None, 0, n, n
                    last = _next(last, payload)
                    if wrong is None and (digest != last or n != at):
                        wrong = n
                    last, rows, at = digest, rows + 1, n + 1
            if segment is not None:
                yield done()

        sorted_rows = self.records().repartition("segment").sortWithinPartitions("segment", "sequence")
        found = sorted_rows.mapInArrow(verified, "segment long, found_tail string, found long, least long, wrong long")
        j = said.join(found, "segment", "full")
        fault = F.when(F.col("n").isNull(), "unknown segment").when(F.col("found").isNull(), "missing segment").when(F.col("wrong").isNotNull(), "record")
        fault = fault.when((F.col("found") != F.col("n")) | (F.col("least") != F.col("first")) | (F.col("found_tail") != F.col("tail")), "tail").otherwise(F.col("fault"))
        return j.select("segment", F.col("wrong").alias("sequence"), fault.alias("fault")).filter("fault IS NOT NULL")

    def torn(self) -> list[str]:
        """Batches that were written and never counted."""
        counted = {h["batch"] for h in self.heads()}
        return [n for n in self.files.names() if n.startswith("batch-") and n not in counted]

    def recover(self) -> list[str]:
        """Sets torn batches aside, under their own names, and says so in the log."""
        torn = self.torn()
        for n in torn:
            self.files.rename(n, f"torn-{n}")
        if torn:
            said = self.spark.createDataFrame([(i, json.dumps({"kind": "recovery", "aside": f"torn-{n}"})) for i, n in enumerate(torn)], "i int, payload string")
            self.append(said, "payload", "i")
        return torn


def json_chain(lines: DataFrame, ends_whole: bool, digest: Callable[[Column], Column], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """A log of JSON lines (sequence, previous, digest and any other fields) as rows, and its faults (sequence, fault).

    Every record is checked by itself, and its link by a join with the one before, so lines may come in any order and
    number. digest: of a line's text, what its record's digest should be. A single line that can't be read, where the
    log doesn't end with a line's end (ends_whole is false), is its torn last one and no fault.
    """
    named = F.from_json(column, "struct<sequence:bigint,previous:string,digest:string>")
    r = kept(lines.select(F.col(column).alias("line"), named.alias("r"), digest(F.col(column)).alias("made")).select("line", "r.*", "made"))
    good = F.col("sequence").isNotNull() & F.col("digest").isNotNull() & F.col("previous").isNotNull()
    broken = r.filter(~F.coalesce(good, F.lit(False)))
    whole = r.filter(good)
    before = whole.select((F.col("sequence") + 1).alias("sequence"), F.col("digest").alias("_before")).distinct()
    links = whole.join(before, "sequence", "left")
    wrong = F.when(F.col("made") != F.col("digest"), "digest").when((F.col("sequence") == 1) & (F.col("previous") != ""), "link")
    wrong = wrong.when((F.col("sequence") != 1) & (F.col("_before").isNull() | (F.col("_before") != F.col("previous"))), "link")
    faults = links.select("sequence", wrong.alias("fault")).filter("fault IS NOT NULL")
    twice = whole.groupBy("sequence").agg(F.count("*").alias("n")).filter("n > 1").select("sequence", F.lit("repeated").alias("fault"))
    unread = broken.count()
    lost = [] if unread <= (not ends_whole) else [(None, f"{unread} lines can't be read")]
    extra = lines.sparkSession.createDataFrame(lost, "sequence long, fault string")
    return whole.select("sequence", "previous", "digest", "line"), faults.union(twice).union(extra)


def _digest_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Moves:
    """Moves of files by a ledger, on all executors: copied, synced and verified; recorded; and only then removed.

    Paths are of a file system that all executors see. A batch of moves that isn't in the ledger has removed nothing, so
    doing it again ends the same way; a source that is recorded as moved and still there is removed when work goes on.
    """

    def __init__(self, ledger: Ledger) -> None:
        self.ledger = ledger

    def state(self) -> DataFrame:
        """src, dst, sha256 of the moves that count and were not undone: the last record of each source."""
        r = self.ledger.records().select("sequence", F.from_json("payload", "struct<kind:string,src:string,dst:string,sha256:string,status:string>").alias("m"))
        r = r.select("sequence", "m.*").filter("status = 'done' AND kind IN ('move', 'undo')")
        home = F.when(F.col("kind") == "move", F.col("src")).otherwise(F.col("dst"))
        last = r.groupBy(home.alias("home")).agg(F.max_by(F.struct("kind", "src", "dst", "sha256"), "sequence").alias("m"))
        return last.filter("m.kind = 'move'").select("m.src", "m.dst", "m.sha256")

    def _done(self, plan: DataFrame, kind: str) -> dict[str, int]:
        """Copies, then records, then removes what the record says was copied."""

        def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = [_copied(Path(s), Path(d), sha) for s, d, sha in zip(*(batch[c].to_pylist() for c in ("src", "dst", "sha256")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["src"], pa.array([str(t) for t, _ in told]), batch["sha256"], pa.array([s for _, s in told])], ["src", "dst", "sha256", "status"])

        importable(plan.sparkSession)
        result = kept(plan.select("src", "dst", "sha256").mapInArrow(copied, "src string, dst string, sha256 string, status string"))
        lines = result.withColumn("payload", F.to_json(F.struct(F.lit(kind).alias("kind"), "src", "dst", "sha256", "status")))
        self.ledger.append(lines, "payload", "src", "dst")
        self._cleared(result.filter("status = 'done'"))
        return {r["status"]: r["n"] for r in result.groupBy("status").agg(F.count("*").alias("n")).collect()}

    def _cleared(self, moved: DataFrame) -> None:
        """Removes the sources of recorded moves, where the copy is whole."""

        def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gone = 0
                for s, d, sha in zip(*(batch[c].to_pylist() for c in ("src", "dst", "sha256")), strict=True):
                    if s != d and Path(s).exists() and Path(d).exists() and _digest_of(Path(d)) == sha == _digest_of(Path(s)):
                        Path(s).unlink(missing_ok=True)
                        gone += 1
                yield pa.RecordBatch.from_arrays([pa.array([gone])], ["gone"])

        moved.select("src", "dst", "sha256").mapInArrow(removed, "gone long").agg(F.sum("gone")).collect()

    def execute(self, plan: DataFrame) -> dict[str, int]:
        """plan: src (once each), dst, sha256; what the ledger says is done is not done again. Counts by status."""
        self.ledger.recover()
        state = kept(self.state())
        known = state.join(plan.select("src"), "src", "left_semi")
        cached = known.count()
        self._cleared(known)
        out = self._done(plan.join(state.select("src"), "src", "left_anti"), "move")
        return out | ({"cached": cached} if cached else {})

    def undo(self) -> dict[str, int]:
        self.ledger.recover()
        return self._done(kept(self.state()).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sha256"), "undo")


def _copied(src: Path, dst: Path, sha: str) -> tuple[Path, str]:
    """Where a file's copy is, and done, refused (its content is another) or failed. A place that other content holds is
    left alone: the copy goes beside it under a short digest, then under the whole one (fixed names)."""
    places = (dst, dst.with_name(f"{dst.stem}__{sha[:16]}{dst.suffix}"), dst.with_name(f"{dst.stem}__{sha}{dst.suffix}"))
    held = next((p for p in places if p.exists() and _digest_of(p) == sha), None)
    if not src.exists() or _digest_of(src) != sha:
        # an earlier try may have come as far as to remove the source
        return (held, "done") if held and not src.exists() else (dst, "refused")
    if held:
        return held, "done"
    dst.parent.mkdir(parents=True, exist_ok=True)
    beside = dst.with_name(f".{dst.name}.{uuid.uuid4().hex}")
    try:
        shutil.copy2(src, beside)
        with beside.open("rb+") as f:
            os.fsync(f.fileno())
        if _digest_of(beside) != sha:
            return dst, "failed"
        for to in places:
            try:
                os.link(beside, to)  # fails where another task or file came first
                return to, "done"
            except FileExistsError:
                if _digest_of(to) == sha:
                    return to, "done"
        return dst, "refused"
    finally:
        beside.unlink(missing_ok=True)
