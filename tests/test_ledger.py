"""Chained logs in segments: what verification finds, crashes between writing and counting, moves of files, JSON chains."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources import ledger
from tessera.sources.ledger import Ledger, Moves


def lines(spark, n, start=0):
    return spark.createDataFrame([(i, f"line {i % 7}" if i % 11 else None) for i in range(start, start + n)], "i long, text string").repartition(3)


def test_records_digests_and_heads_by_hand(spark, tmp_path):
    log = Ledger(spark, str(tmp_path / "log"), 10)
    assert log.append(lines(spark, 25), "text", "i") == 25 and log.append(lines(spark, 7, 25), "text", "i") == 7 and log.append(lines(spark, 0), "text", "i") == 0
    got = {r.sequence: r for r in log.records().collect()}
    assert sorted(got) == list(range(1, 33))
    digest, head, heads = "", "", []
    for n in range(1, 33):
        segment = (n - 1) // 10 if n <= 25 else 3
        if segment == len(heads):
            digest = hashlib.sha256(f"segment:{segment}".encode()).hexdigest()
            heads.append(0)
        payload = f"line {(n - 1) % 7}" if (n - 1) % 11 else ""
        digest = hashlib.sha256(f"{digest}\n{payload}".encode()).hexdigest()
        heads[segment] += 1
        assert (got[n].segment, got[n].digest, got[n].payload or "") == (segment, digest, payload)
    for h, n in zip(log.heads(), heads, strict=True):
        head = hashlib.sha256(f"{head}\n{h['tail']}\n{n}".encode()).hexdigest()
        assert (h["records"], h["head"]) == (n, head)
    assert log.faults().count() == 0


@pytest.mark.parametrize(("change", "fault"), [("payload", "record"), ("digest", "record"), ("sequence", "record"), ("drop_last", "tail"), ("drop_segment", "missing segment"), ("forged", "tail"), ("head", "head")])
def test_what_is_changed_is_found(spark, tmp_path, change, fault):
    log = Ledger(spark, str(tmp_path / "log"), 10)
    log.append(lines(spark, 45), "text", "i")
    rows, heads = log.records(), log.heads()
    at = F.col("sequence") == 23
    new = {
        "payload": lambda: rows.withColumn("payload", F.when(at, "other").otherwise(F.col("payload"))),
        "digest": lambda: rows.withColumn("digest", F.when(at, "0").otherwise(F.col("digest"))),
        "sequence": lambda: rows.withColumn("sequence", F.when(at, 99).otherwise(F.col("sequence"))),
        "drop_last": lambda: rows.filter("sequence <> 30"),
        "drop_segment": lambda: rows.filter("segment <> 2"),
        "forged": lambda: rows.filter("sequence <> 30").union(spark.createDataFrame([(2, 30, "new", ledger._next(next(r.digest for r in rows.collect() if r.sequence == 29), "new"))], rows.schema)),
        "head": lambda: rows,
    }[change]()
    new.write.parquet(str(tmp_path / "log" / "batch-x"))
    changed = [h | {"batch": "batch-x"} | ({"head": "0"} if change == "head" and h["number"] == 2 else {}) for h in heads]
    (tmp_path / "log" / "heads-000000000099.json").write_text(json.dumps(changed))
    got = log.faults().collect()
    assert [(r.segment, r.fault) for r in got] == [(2, fault)] and all(r.sequence in (23, 24, 99) for r in got if fault == "record")


def test_a_crash_leaves_the_old_log(spark, tmp_path, monkeypatch):
    log = Ledger(spark, str(tmp_path / "log"), 10)
    log.append(lines(spark, 15), "text", "i")
    monkeypatch.setattr(Ledger, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        log.append(lines(spark, 15), "text", "i")
    monkeypatch.undo()
    again = Ledger(spark, str(tmp_path / "log"), 10)
    assert again.records().count() == 15 and again.faults().count() == 0 and len(again.torn()) == 1
    aside = again.recover()
    assert again.torn() == [] and again.records().count() == 16 and again.faults().count() == 0 and (tmp_path / "log" / f"torn-{aside[0]}").exists()
    assert json.loads(again.records().orderBy(F.desc("sequence")).first().payload)["kind"] == "recovery" and again.recover() == []
    (tmp_path / "log" / f"heads-{len(again.heads()) + 1:012}.json").write_text("[]")
    with pytest.raises(RuntimeError):
        again._publish([*again.heads(), {}] if again.heads() else [{}] * 4)


def files(spark, tmp_path):
    src, rows = tmp_path / "in", []
    src.mkdir()
    for i in range(12):
        (src / f"{i}.png").write_bytes(b"data%d" % (i // 2 if i > 7 else i))
        rows.append((str(src / f"{i}.png"), str(tmp_path / "out" / ("same.png" if i < 4 or i > 7 else f"{i}.png")), hashlib.sha256((src / f"{i}.png").read_bytes()).hexdigest()))
    rows += [(str(src / "gone.png"), str(tmp_path / "out/gone.png"), "0"), (str(src / "wrong.png"), str(tmp_path / "out/wrong.png"), "0")]
    (src / "wrong.png").write_bytes(b"not that")
    return src, spark.createDataFrame(rows, "src string, dst string, sha256 string").repartition(4)


def test_moves_and_their_undoing(spark, tmp_path):
    src, plan = files(spark, tmp_path)
    before = {p.name: p.read_bytes() for p in src.iterdir()}
    m = Moves(Ledger(spark, str(tmp_path / "log"), 5))
    assert m.execute(plan) == {"done": 12, "refused": 2} and [p.name for p in src.iterdir()] == ["wrong.png"]
    assert {p.read_bytes() for p in (tmp_path / "out").iterdir()} == {v for k, v in before.items() if k != "wrong.png"}
    again = Moves(Ledger(spark, str(tmp_path / "log"), 5))
    assert again.execute(plan) == {"cached": 12, "refused": 2} and again.state().count() == 12
    assert again.undo() == {"done": 12} and {p.name: p.read_bytes() for p in src.iterdir()} == before and again.state().count() == 0
    assert not list((tmp_path / "out").iterdir()) and again.ledger.faults().count() == 0
    assert again.execute(plan) == {"done": 12, "refused": 2}


@pytest.mark.parametrize("when", ["before the record", "after the record"])
def test_a_crash_during_moves_loses_nothing(spark, tmp_path, monkeypatch, when):
    src, plan = files(spark, tmp_path)
    before = sorted(p.read_bytes() for p in src.iterdir())
    append = Ledger.append

    def crash(self, *a):
        if when == "after the record":
            append(self, *a)
        raise KeyboardInterrupt

    monkeypatch.setattr(Ledger, "append", crash)
    with pytest.raises(KeyboardInterrupt):
        Moves(Ledger(spark, str(tmp_path / "log"), 5)).execute(plan)
    monkeypatch.undo()
    assert sorted(p.read_bytes() for p in src.iterdir()) == before
    m = Moves(Ledger(spark, str(tmp_path / "log"), 5))
    m.execute(plan)
    assert {p.read_bytes() for p in (tmp_path / "out").iterdir()} | {b"not that"} == set(before) and m.state().count() == 12
    assert [p.name for p in src.iterdir()] == ["wrong.png"]


def test_copies_to_one_place_at_once(tmp_path):
    """Twelve threads with three contents and one place: each content is somewhere, none is overwritten."""
    for i in range(12):
        (tmp_path / f"s{i}").write_bytes(b"x%d" % (i % 3))
    sha = [hashlib.sha256(b"x%d" % i).hexdigest() for i in range(3)]
    got = {}
    run = lambda i: got.__setitem__(i, ledger._copied(tmp_path / f"s{i}", tmp_path / "d" / "a.b", sha[i % 3]))
    threads = [threading.Thread(target=run, args=(i,)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert all(s == "done" and p.read_bytes() == b"x%d" % (i % 3) for i, (p, s) in got.items())


def test_json_chain(spark):
    made = lambda line: F.sha2(F.concat(F.get_json_object(line, "$.previous"), F.get_json_object(line, "$.text")), 256)
    out, before = [], ""
    for n in range(1, 30):
        digest = hashlib.sha256(f"{before}text {n}".encode()).hexdigest()
        out.append(json.dumps({"sequence": n, "previous": before, "digest": digest, "text": f"text {n}"}))
        before = digest
    read = lambda rows, whole=True: ledger.json_chain(spark.createDataFrame([(x,) for x in rows], "value string").repartition(3), whole, made)
    told = lambda rows, whole=True: sorted((r.sequence or 0, r.fault) for r in read(rows, whole)[1].collect())
    assert told(out) == [] and read(out)[0].count() == 29 and told(out[::-1]) == []
    assert told([*out, '{"sequence": 30, "pre'], False) == [] and told([*out, '{"sequence": 30, "pre']) == [(0, "1 lines can't be read")]
    assert told([*out[:4], out[4].replace("text 5", "text x"), *out[5:]]) == [(5, "digest")]
    assert told([*out[:4], *out[5:]]) == [(6, "link")] and told(out[1:]) == [(2, "link")] and (7, "repeated") in told([*out, out[6]])
