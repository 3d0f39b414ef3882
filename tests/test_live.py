"""Streams against the batch operators, however their events are cut into batches and shuffled."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events, live, memory

START = datetime.datetime(2026, 1, 1)
END = "2026-03-01 00:00:00"


def rows_of(seed):
    r, out = random.Random(seed), []
    for seq in range(120):
        key, action = f"k{r.randrange(6)}", r.choice(["confirm", "new", "ignore", "wrong_box"])
        out.append((key, str(START + datetime.timedelta(minutes=seq * 3)), seq, action, r.choice(["ann", "bob"]), r.choice([None, "baseline", "variant"])))
    return out


def ran(spark, tmp_path, rows, schema, build, parts, seed):
    """What a stream gives, its input cut into parts of files; within half an hour events come in any order."""
    r = random.Random(seed)
    shuffled = sorted(rows, key=lambda x: (datetime.datetime.fromisoformat(x[1]) - START).total_seconds() / 60 + r.uniform(0, 30))
    last = [("end", END, 10**6, *[None] * (len(rows[0]) - 3))]
    for i in range(parts):
        # the last file moves the watermark past all the others
        spark.createDataFrame(shuffled[i * len(rows) // parts : (i + 1) * len(rows) // parts] + (last if i == parts - 1 else []), schema).coalesce(1).write.parquet(str(tmp_path / f"in{parts}" / f"{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / f"in{parts}"))
    q = build(stream).writeStream.format("memory").queryName(f"out_{tmp_path.name.replace('-', '_')}_{parts}").outputMode(build.mode).option("checkpointLocation", str(tmp_path / f"ck{parts}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(q.name).collect()


def stream_of(build, mode):
    build.mode = mode
    return build


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


SCHEMA = "k string, ts string, seq long, action string, name string, mark string"


@pytest.mark.parametrize("parts", [1, 6])
def test_folds_end_where_the_batch_does(spark, tmp_path, parts):
    rows = rows_of(parts)
    df = spark.createDataFrame(rows, SCHEMA)
    last = lambda got: {r.k: json.loads(r.state) for r in sorted(got, key=lambda r: r.seq) if r.k != "end"}
    got = last(ran(spark, tmp_path, rows, SCHEMA, stream_of(lambda s: live.folded(s, "k", live.naming_step), "update"), parts, 3))
    assert got == {r.k: {"name": r.name, "excluded": r.excluded} for r in events.naming_fold(df).collect()}
    faces = df.select(F.col("k").alias("face"), "seq", "action", F.col("name").alias("character"), "mark")
    step = lambda s, e: live.memory_step(s, {**e, "character": e["name"]})
    at = tmp_path / "memory"
    at.mkdir()
    got = last(ran(spark, at, rows, SCHEMA, stream_of(lambda s: live.folded(s, "k", step), "update"), parts, 4))
    assert {k: (v["character"], v["mark"]) for k, v in got.items() if v["character"]} == {r.face: (r.character, r.mark) for r in memory.memory_fold(faces).collect()}


def test_tray_ends_where_the_batch_does(spark, tmp_path):
    r = random.Random(5)
    images = {f"i{n}": (n % 2, "pending") for n in range(5)}
    rows = []
    for seq in range(80):
        image = f"i{r.randrange(5)}"
        rows.append((image, str(START + datetime.timedelta(minutes=seq)), seq, r.choice(["archive", "reopen", "defer", "unknown-foreign", "notify", "notify"]), r.choice(["a", "b", None]), *images[image]))
    schema = "image string, ts string, seq long, action string, trigger string, subjects int, disposition string"
    got = ran(spark, tmp_path, rows, schema, stream_of(lambda s: live.folded(s, "image", live.tray_step), "update"), 4, 6)
    state = {r.k: json.loads(r.state) for r in sorted(got, key=lambda r: r.seq) if r.k != "end"}
    want = memory.tray_fold(spark.createDataFrame(rows, schema).drop("subjects", "disposition"), spark.createDataFrame([(k, *v) for k, v in images.items()], "image string, subjects int, disposition string"))
    assert state == {r.image: {"archived": r.archived, "disposition": r.disposition, "triggers": list(r.triggers), "refused": r.refused} for r in want.collect()}


@pytest.mark.parametrize("parts", [1, 5])
def test_stalls_are_the_gaps(spark, tmp_path, parts):
    r = random.Random(parts)
    rows, at = [], 0
    for seq in range(100):
        at += r.choice([5, 20, 59, 60, 61, 300])
        rows.append((f"r{r.randrange(3)}", str(START + datetime.timedelta(seconds=at)), seq))
    schema = "k string, ts string, seq long"
    got = ran(spark, tmp_path, rows, schema, stream_of(lambda s: live.stalls(s, "k", 60), "append"), parts, 7)
    by = {}
    for k, ts, _ in rows:
        by.setdefault(k, []).append(int((datetime.datetime.fromisoformat(ts) - datetime.datetime(1970, 1, 1)).total_seconds()))
    want = {(k, a * 1000) for k, v in by.items() for a, b in zip(v, [*v[1:], 10**12]) if b - a > 60}
    assert {(x.k, x.since) for x in got if x.k != "end"} == want and len(got) >= len(want)
    batch = events.gaps(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")), "k", "ts", 60)
    assert {(x.k, int(x.before.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1000) for x in batch.collect()} <= want
