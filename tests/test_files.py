"""Readers, artifacts, adapters and ingestion on files of the test's own."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import adapters
from tessera.sources import artifacts, images, readers
from tessera.streaming import ingest, memory


def png(width=3, height=2, colour=2, cut=0, broken=False):
    channels = images.MODES[colour][0]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b) ^ (broken and k == b"IDAT"))
    rows = b"".join(b"\0" + bytes(width * channels) for _ in range(height - cut))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in rows], "path string, content binary")


def test_scan(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xd9"
    good, refused = readers.scan(files(spark, ("b", png()), ("a", png()), ("c", png(5, 4, 6)), ("d", jpeg), ("e", jpeg[:-2]), ("f", png(cut=1)), ("g", png(broken=True)), ("h", png()[:-6]), ("i", b""), ("j", b"GIF89a")))
    rows = good.collect()
    assert [r.sha256 for r in rows] == sorted(r.sha256 for r in rows) and {(r.path, r.width, r.height, r.mode) for r in rows} == {("a", 3, 2, "RGB"), ("c", 5, 4, "RGBA"), ("d", 7, 5, "L")}
    assert {r.path for r in refused.collect()} == set("efghij")
    two, _ = readers.scan(files(spark, ("b", png()), ("c", png(5, 4, 6)), ("d", jpeg)), 2)
    assert [r.sha256 for r in two.collect()] == [r.sha256 for r in rows][:2]
    m = spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "z"), ("t", "z")], "sha16 string, sha256 string")
    assert [tuple(r) for r in readers.collisions(m).collect()] == [("s", 2)]


def test_documents(spark, tmp_path):
    at = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    schema = "faces array<struct<id: string, box: array<int>>>, n int"
    ok = at("a.json", json.dumps({"faces": [{"id": "f", "box": [1, 2]}], "n": 1}))
    assert readers.typed_document(spark, ok, schema).first().faces[0].id == "f"
    for bad in ({"faces": [], "m": 1}, {"faces": [{"id": "f", "extra": 1}]}):
        with pytest.raises(ValueError, match="unknown"):
            readers.typed_document(spark, at("b.json", json.dumps(bad)), schema)
    assert readers.typed_document(spark, at("b.json", '{"n": 2, "m": 3}'), schema, True).first().n == 2
    with pytest.raises(Exception, match="n|FAILFAST|MALFORMED"):
        readers.typed_document(spark, at("c.json", '{"n": "x"}'), schema).collect()
    rows = "id string, n int"
    assert readers.sidecar(spark, str(tmp_path / "none.json"), rows).count() == 0
    assert sorted(map(tuple, readers.sidecar(spark, at("d.json", '{"a": {"n": 1}, "b": {"n": "x"}}'), rows).collect())) == [("a", 1), ("b", None)]
    assert readers.sidecar(spark, at("e.json", "{"), rows, True).count() == 0
    with pytest.raises(ValueError):
        readers.sidecar(spark, at("e.json", "{"), rows)
    assert [tuple(r) for r in readers.tag_vocabulary(spark, at("t.csv", 'name,category\n"a,b",4\nc,0\n')).collect()] == [("a,b", 4), ("c", 0)]
    with pytest.raises(Exception, match="no category"):
        readers.tag_vocabulary(spark, at("t.csv", "name,category\na,x\n")).collect()
    assert readers.settings("uncertain: 2.5 # limit\nworkers: 4\n") == readers.Settings(uncertain=2.5, workers=4)
    for bad in ("nothing: 1", "workers: 0", "gaming: x", "workers: 1\nworkers: 2"):
        with pytest.raises(ValueError):
            readers.settings(bad)
    view = readers.score_view(spark.createDataFrame([(2, '{"a": 1.5}'), (1, '{"a": null, "b": "x"}')], "position int, payload string"), {"a": "double", "b": "string"})
    assert [tuple(r) for r in view.collect()] == [(1, None, "x"), (2, 1.5, None)]


def test_logs_caches_references_and_seals(spark):
    lines = spark.createDataFrame([("2026-01-01 10:00:00,5 INFO pass done=3 of 9",), ("noise",)], "value string")
    got = readers.log_progress(lines, r"^(\S+ \S+),\d+ INFO pass done=(\d+) of (\d+)", {"ts": "timestamp", "done": "int", "all": "int"}).collect()
    assert [(str(r.ts), r.done, r["all"]) for r in got] == [("2026-01-01 10:00:00", 3, 9)]
    shas = [hashlib.sha256(bytes([i])).hexdigest() for i in range(3)] + ["a" * 16 + "b" * 48, "a" * 16 + "c" * 48]
    key = lambda s: hashlib.sha256(f"hs|{s[:16]}".encode()).hexdigest()
    e = spark.createDataFrame([(key(shas[0]), "x"), (key(shas[3]), "y"), ("other", "z")], "key string, value string")
    assert {(r.value, r.status, r.sha256) for r in readers.short_cache(e, "hs", spark.createDataFrame([(s,) for s in shas], "sha256 string")).collect()} == {("x", "reused", shas[0]), ("y", "ambiguous", None), ("z", "orphan", None)}
    paths = spark.createDataFrame([("/r/a.png",), ("/r/miku/1.png",), ("/r/skip/1.png",), ("/other/x.png",), ("/r/miku/sub/2.png",)], "path string")
    assert {tuple(r) for r in readers.reference_files(paths, "/r", ("skip",)).collect()} == {("/r/a.png", None), ("/r/miku/1.png", "miku"), ("/r/miku/sub/2.png", "miku")}
    f = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("d", bytearray(b"4"))], "name string, content binary")
    seal = {"a": hashlib.sha256(b"1").hexdigest(), "b": hashlib.sha256(b"x").hexdigest(), "c": "0"}
    assert {tuple(r) for r in readers.sealed(f, seal).collect()} == {("a", "verified"), ("b", "changed"), ("c", "missing")}


def test_matrix_and_contents(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:02}", [float(i), -1.5]) for i in range(20)], "id string, v array<double>").repartition(3)
    digest, ids = artifacts.save_matrix(rows, tmp_path / "m.npy")
    want = readers.Vectors(digest, tuple(ids))
    got = readers.vectors(spark, str(tmp_path / "m.npy"), want).collect()
    assert np.load(tmp_path / "m.npy").dtype == np.float16 and [(r.id, r.position, list(r.v)) for r in got] == [(f"k{i:02}", i, [float(i), -1.5]) for i in range(20)]
    for bad in (readers.Vectors("0", want.ids), readers.Vectors(digest, want.ids[:-1]), readers.Vectors(digest, want.ids, "float32")):
        with pytest.raises(ValueError):
            readers.vectors(spark, str(tmp_path / "m.npy"), bad)
    c = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "content binary")
    assert artifacts.keep_contents(c, str(tmp_path / "kept")).distinct().count() == 2
    path = next((tmp_path / "kept").rglob(hashlib.sha256(b"two").hexdigest()))
    path.write_bytes(b"changed")
    assert [bytes(r.content) for r in artifacts.kept_contents(spark, str(tmp_path / "kept")).collect()] == [b"one"]


def test_stores_bundles_and_reports(spark, tmp_path):
    s = artifacts.Store(spark, str(tmp_path / "db"))
    s.replace("rows", spark.range(3))
    s.replace("rows", spark.range(5))
    s.upsert("meta", spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), "k")
    s.upsert("meta", spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), "k")
    s.append("timings", spark.range(2))
    s.append("timings", spark.range(2))
    assert s.read("rows").count() == 5 and {tuple(r) for r in s.read("meta").collect()} == {("a", 1), ("b", 2), ("c", 2)} and s.read("timings").count() == 4
    artifacts.export_bundle({"a": spark.range(4), "b": s.read("meta")}, str(tmp_path / "bundle"))
    assert artifacts.restore_bundle(spark, str(tmp_path / "bundle"), str(tmp_path / "back"))["b"].count() == 3
    with pytest.raises(ValueError, match="empty"):
        artifacts.restore_bundle(spark, str(tmp_path / "bundle"), str(tmp_path / "back"))
    mem = spark.createDataFrame([("x", ["f1"]), ("y", [])], "name string, faces array<string>")
    artifacts.export_memory(mem, tmp_path / "m.json", "c1", "p1")
    assert sorted(map(str, artifacts.import_memory(spark, tmp_path / "m.json", "name string, faces array<string>", "c1", "p1").collect())) == sorted(map(str, mem.collect()))
    with pytest.raises(ValueError):
        artifacts.import_memory(spark, tmp_path / "m.json", "name string, faces array<string>", "c2", "p1")
    artifacts.report_files(mem.select("name", F.lit(None).cast("string").alias("x")), ["name", "x"], {"rows": 2}, tmp_path / "r", "Report")
    assert (tmp_path / "r/rows.csv").read_text().splitlines() == ['"name","x"', '"x",""', '"y",""'] and "| rows | 2 |" in (tmp_path / "r/report.md").read_text()
    artifacts.seal_report({"n": 1}, tmp_path / "r", ["rows.csv"])
    assert artifacts.opened_report(tmp_path / "r")["n"] == 1
    (tmp_path / "r/rows.csv").write_text("other")
    with pytest.raises(ValueError):
        artifacts.opened_report(tmp_path / "r")


def test_adapters(spark):
    rows = spark.createDataFrame([(i, float(i) if i != 3 else None) for i in range(10)], "k int, payload double")
    p = adapters.Predictor("half", "r1", "none", lambda: lambda xs: np.array(xs) / 10, 0.0, 1.0)
    plain = adapters.predicted(rows, p, 4)
    assert {(r.k, r.value) for r in plain.collect()} == {(i, i / 10 if i != 3 else None) for i in range(10)} and plain.first().lineage == "half|r1|none"
    less = adapters.predicted(rows, adapters.Predictor("half", "r1", "none", p.load, 0.0, 1.0, lambda x: x * 0.5))
    assert {(r.k, r.gaming_delta and round(r.gaming_delta, 6)) for r in adapters.gaming_delta(plain, [less, plain]).collect()} == {(i, round(i / 20, 6) if i != 3 else None) for i in range(10)}
    with pytest.raises(Exception, match="contract"):
        adapters.predicted(rows, adapters.Predictor("bad", "r", "n", lambda: lambda xs: np.array(xs), 0.0, 1.0)).collect()
    boxes = adapters.detected(rows, lambda: lambda x: [(0, 0, x, x, 0.5)] * int(x % 3))
    assert boxes.count() == sum(i % 3 for i in range(10) if i != 3)
    v = adapters.embedded(rows.filter("payload > 0"), lambda: lambda xs: np.array([[x, 0.0] for x in xs]), 2)
    assert {tuple(r.v) for r in v.collect()} == {(1.0, 0.0)}
    r = np.random.default_rng(2)
    points = [(b * 20 + i, (np.eye(8)[b] + r.normal(0, 0.02, 8)).tolist()) for b in range(3) for i in range(20)]
    points = spark.createDataFrame([(k, (np.array(x) / np.linalg.norm(x)).tolist(), k // 2) for k, x in points], "k int, v array<double>, image int")
    for method in ("density_tree", "dbscan", "whispers"):
        got = {r.k: r.cluster for r in adapters.clustered(points, method).collect()}
        assert len(set(got.values())) == 3 and all(got[k] == got[k // 20 * 20] for k in got)
    found = adapters.rediscovered(points, "dbscan", 11)
    assert {(r.members, r.images, r.seed) for r in found.collect()} == {(20, 10, False)}


def test_ingestion(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(7):
        (src / f"{i}.bin").write_bytes(b"content %d" % (i % 5))
    look = lambda b: b.select(F.sha2("content", 256).alias("sha256"), F.col("length"))
    ingest.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), look, 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    (src / "8.bin").write_bytes(b"new")
    ingest.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), look, 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    one = ingest.snapshot(files(spark, ("b", b"1"), ("a", b"1"), ("c", b"2"), ("d", None)))
    assert {tuple(r)[::2] for r in one.collect()} == {("a", "indexed"), ("b", "duplicate"), ("c", "indexed"), ("d", "unavailable")}
    rev, inv = ingest.freeze(one, None, "p1")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert rev == sha(json.dumps(["p1", [["a", sha(b"1"), "indexed"], ["b", sha(b"1"), "duplicate"], ["c", sha(b"2"), "indexed"], ["d", None, "unavailable"]]], separators=(",", ":")).encode())
    now = files(spark, ("a", b"1"), ("c", b"3"), ("e", b"4"))
    rev2, inv2 = ingest.freeze(ingest.snapshot(now), inv, "p1")
    assert rev2 != rev and {(r.path, r.status, r.change) for r in inv2.collect()} == {("a", "indexed", "same"), ("b", "unavailable", "removed"), ("c", "indexed", "changed"), ("e", "indexed", "added")}
    assert {r.path for r in ingest.mutated(inv, now).collect()} == {"b", "c"}
    decisions = spark.createDataFrame([(1, "auto"), (2, None)], "k int, tier string")
    seen = ingest.preview(decisions)
    assert seen == ingest.preview(decisions.repartition(3)) and ingest.execute(decisions, seen, str(tmp_path / "run")).count() == 2 == ingest.execute(decisions, seen, str(tmp_path / "run")).count()
    with pytest.raises(ValueError):
        ingest.execute(decisions.filter("k = 1"), seen, str(tmp_path / "run"))


def test_stages_journals_and_migrations(spark):
    e = spark.createDataFrame([("j", i, s) for i, s in enumerate(["INGEST", "PROPOSE", "ANALYZE", "PROPOSE", "REVIEW", "CONFIRM", "INGEST"])] + [("k", 0, "CONFIRM")], "job string, seq int, stage string")
    assert [(r.stage, r.status) for r in memory.stage_states(e).filter("job = 'j'").sort("seq").collect()] == [("INGEST", "ok"), ("INGEST", "invalid"), ("ANALYZE", "ok"), ("PROPOSE", "ok"), ("PROPOSE", "future-stage"), ("CONFIRM", "ok"), ("CONFIRM", "invalid")]
    log = [("mark", "a", None, 1, "baseline"), ("mark", "a", None, 2, None), ("mark", "b", None, 3, None), ("rename", "a", "c", None, None), ("mark", "c", None, 1, None), ("merge", "b", "c", None, None), ("clear", None, None, 2, None), ("mark", "d", None, 4, None), ("delete", "d", None, None, None)]
    j = spark.createDataFrame([("x", i, *r) for i, r in enumerate(log)] + [("y", 0, "mark", "q", None, 9, None), ("y", 1, "import", None, None, None, None)], "journal string, seq int, action string, name string, target string, face int, mark string")
    assert {tuple(r) for r in memory.replay_journal(j).collect()} == {("x", 1, "c", "baseline"), ("x", 3, "c", None)}
    ledger = lambda *rows: spark.createDataFrame(list(rows), "version int, digest string")
    steps = [(1, "a"), (2, "b"), (3, "c")]
    assert memory.migrations(ledger((1, "a")), steps) == [(2, "b"), (3, "c")]
    for bad in (((2, "b"),), ((1, "x"),), ((1, "a"), (2, "b"), (3, "c"), (4, "d"))):
        with pytest.raises(ValueError):
            memory.migrations(ledger(*bad), steps)
