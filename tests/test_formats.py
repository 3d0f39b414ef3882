"""Matrices and logs read and written in ranges: partitions, filters that reach them, damage, and round trips."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan
from pyspark.sql.types import StructType

from tessera.sources import formats, ledger


def vectors(n=500, width=7):
    m = np.random.default_rng(2).normal(size=(n, width)).astype(np.float32)
    return [f"k{i:04}" for i in range(n)], m


@pytest.mark.parametrize("dtype", ["float32", "float16"])
def test_round_trip_and_digests(spark, tmp_path, dtype):
    keys, m = vectors()
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, m, strict=True)], "id string, v array<double>").repartition(6)
    at = str(tmp_path / "m.npy")
    ids = formats.write_matrix(rows, at, dtype)
    want = m.astype(dtype)
    assert (np.load(at) == want).all() and [r.id for r in ids.orderBy("position").collect()] == keys
    told = json.loads((tmp_path / "m.npy.ranges.json").read_text())
    raw = want.tobytes()
    line = want.itemsize * 7
    assert all(r["sha256"] == hashlib.sha256(raw[r["first"] * line : (r["first"] + r["rows"]) * line]).hexdigest() for r in told["ranges"]) and sum(r["rows"] for r in told["ranges"]) == 500
    assert formats.file_digest(at) == hashlib.sha256((tmp_path / "m.npy").read_bytes()).hexdigest()
    got = formats.read_matrix(spark, at).orderBy("position").collect()
    assert np.array_equal(np.array([r.v for r in got], np.float32), want.astype(np.float32)) and not list(tmp_path.glob("*.part"))
    data = bytearray((tmp_path / "m.npy").read_bytes())
    data[-3] ^= 1
    (tmp_path / "m.npy").write_bytes(data)
    with pytest.raises(Exception, match="are not what was written"):
        formats.read_matrix(spark, at).agg(F.count("v")).collect()


def test_ranges_and_filters(spark, tmp_path):
    _, m = vectors()
    at = str(tmp_path / "plain.npy")
    np.save(at, m)
    df = formats.read_matrix(spark, at, rangeBytes=str(28 * 40))
    assert df.rdd.getNumPartitions() == 13 and df.schema.simpleString() == "struct<position:bigint,v:array<float>>"
    bounded = formats.read_matrix(spark, at, rangeBytes=str(28 * 40), low="100", high="130")
    assert bounded.rdd.getNumPartitions() == 2 and sorted(r.position for r in bounded.collect()) == list(range(100, 130))
    pushed = lambda where: formats.read_matrix(spark, at, True, rangeBytes=str(28 * 40)).filter(where)
    for where, parts, rows in (("position >= 100 AND position < 130", 2, 30), ("position = 499", 1, 1), ("position IN (3, 45)", 2, 2), ("position > 600", 1, 0), ("v[0] > 100", 13, 0)):
        got = pushed(where)
        assert got.rdd.getNumPartitions() == parts and got.count() == rows == df.filter(where).count()
    assert df.count() == 500
    only = spark.read.format("matrix").schema("position bigint").options(path=at).load()
    assert only.count() == 500 and only.columns == ["position"]
    reader = formats.PushedMatrixReader(StructType.fromDDL("position bigint"), {"path": at, "rangeBytes": str(28 * 40)})
    filters = [GreaterThanOrEqual(("position",), 80), LessThan(("position",), 121), IsNotNull(("position",)), EqualTo(("other",), 1)]
    assert list(reader.pushFilters(filters)) == filters and [(p.low, p.high) for p in reader.partitions()] == [(80, 120), (120, 160)]
    assert list(reader.pushFilters([In(("position",), (90, 95))])) and [(p.low, p.high) for p in reader.partitions()] == [(80, 120)]


def test_what_is_no_matrix_is_refused(spark, tmp_path):
    for name, value in (("flat", np.zeros(3)), ("columns", np.asfortranarray(np.zeros((3, 2))))):
        np.save(tmp_path / f"{name}.npy", value)
        with pytest.raises(Exception, match="rows of numbers"):
            formats.read_matrix(spark, str(tmp_path / f"{name}.npy"))
    np.save(tmp_path / "cut.npy", np.zeros((9, 4)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-1])
    with pytest.raises(Exception, match="of another length"):
        formats.read_matrix(spark, str(tmp_path / "cut.npy"))
    for bad in ([1.0, 2.0, 3.0], [1.0, float("nan")]):
        rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", bad)], "id string, v array<double>")
        with pytest.raises(Exception, match="another width"):
            formats.write_matrix(rows, str(tmp_path / "bad.npy"))
    assert not (tmp_path / "bad.npy").exists()


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_every_line_once_whatever_the_ranges(spark, tmp_path, step):
    r = random.Random(step)
    lines = ["".join(r.choice("ab é\t") for _ in range(r.randrange(30))) for _ in range(60)] + ["", "x" * 300]
    text = "\n".join(lines) + "\ntorn"
    at = tmp_path / "log"
    at.write_text(text)
    reader = formats.LinesReader(StructType.fromDDL("offset bigint, line string, whole boolean"), {"path": str(at), "rangeBytes": str(step)})
    got = [row for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]
    offsets = [len(("\n".join(lines[:i]) + "\n").encode()) if i else 0 for i in range(len(lines) + 1)]
    assert [(x["offset"], x["line"], x["whole"]) for x in got] == [(o, x, i < len(lines)) for i, (o, x) in enumerate(zip(offsets, [*lines, "torn"], strict=True))]


def test_log_lines_with_filters_and_chains(spark, tmp_path):
    before, out = "", []
    for n in range(1, 200):
        digest = hashlib.sha256(f"{before}t{n}".encode()).hexdigest()
        out.append(json.dumps({"sequence": n, "previous": before, "digest": digest, "text": f"t{n}"}))
        before = digest
    at = tmp_path / "log"
    at.write_text("\n".join(out) + '\n{"sequence": 200, "pre')
    df = formats.read_lines(spark, str(at), rangeBytes="4096")
    parts = df.rdd.getNumPartitions()
    late = formats.read_lines(spark, str(at), True, rangeBytes="4096").filter("offset >= 20000")
    assert parts > 8 and late.rdd.getNumPartitions() < parts - 3 and late.count() == sum(1 for r in df.collect() if r.offset >= 20000)
    made = lambda line: F.sha2(F.concat(F.get_json_object(line, "$.previous"), F.get_json_object(line, "$.text")), 256)
    ends = df.agg(F.max_by("whole", "offset")).first()[0]
    records, faults = ledger.json_chain(df, ends, made, "line")
    assert not ends and records.count() == 199 and faults.count() == 0
