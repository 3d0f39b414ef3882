"""Order-dependent operators against plain passes over small rows."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import layout, ordered
from tessera.plans import selection
from tessera.sources import images


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = selection._vectors(spark, data).orderBy("k").collect()
    return [r.k for r in rows], [r.label for r in rows], np.array([r.v for r in rows])


def test_greedy_pass(spark):
    r = random.Random(1)
    pairs = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(150)})
    keep = []
    for k in range(60):
        if not any((a, k) in pairs for a in keep):
            keep.append(k)
    got = ordered.greedy_keep(spark.range(60).select(F.col("id").alias("k")), spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(x.k for x in got.collect()) == keep


def test_wall(spark, data, vectors):
    ks, labels, v = vectors
    got = {}
    for r in selection.representative_wall(spark, data).collect():
        got.setdefault(r.g, {})[r.place] = r.k
    for g in set(labels):
        at = [i for i, x in enumerate(labels) if x == g]
        m = v[at]
        total = m.sum(0)
        loo = [float(x @ (total - x) / np.linalg.norm(total - x)) for x in m]
        chosen = [min(range(len(at)), key=lambda i: (-float(m[i] @ total), ks[at[i]]))]
        low = min(range(len(at)), key=lambda i: (loo[i], ks[at[i]]))
        chosen += [low] if low not in chosen else []
        while len(chosen) < min(12, len(at)):
            chosen.append(min((i for i in range(len(at)) if i not in chosen), key=lambda i: (max(float(m[i] @ m[j]) for j in chosen), ks[at[i]])))
        assert [got[g][p + 1] for p in range(len(chosen))] == [ks[at[i]] for i in chosen]


def test_wall_without_coherence(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 0, [1.0, 0.0]), ("b", 5, [1.0, 0.0])], "g string, k int, v array<double>")
    assert sorted(tuple(r) for r in ordered.representative_wall(df, 2).collect()) == [("a", 0, 1), ("a", 1, 2), ("b", 5, 1)]


def test_whispers(spark, data, vectors):
    ks, _, v = vectors
    sims = v @ v.T
    label = list(range(len(ks)))
    for _ in range(20):
        before = list(label)
        for i in range(len(ks)):
            support = {}
            for j in range(len(ks)):
                if i != j and sims[i, j] >= 0.38:
                    support[label[j]] = support.get(label[j], 0.0) + sims[i, j]
            if support:
                label[i] = min(support, key=lambda x: (-support[x], x))
        if before == label:
            break
    want = {ks[i]: ks[x] if label.count(x) >= 3 else None for i, x in enumerate(label)}
    assert {r.k: r.cluster for r in selection.label_whispers(spark, data).collect()} == want


def test_seeded_sample(spark, data):
    groups = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("source", F.sha2(F.col("doc_id").cast("string"), 256).alias("k")).collect():
        groups.setdefault(r.source, set()).add(r.k)
    got = {}
    for r in selection.seeded_sample(spark, data).collect():
        got.setdefault(r.g, set()).add(r.k)
    assert {g: x for g, x in got.items() if g is not None} == {g: set(random.Random(20260921).sample(sorted(x), min(100, len(x)))) for g, x in groups.items() if g is not None}


def test_suppression(spark):
    rows = [(1, 50, 40, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 50, 40, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 50, 40, 30.5, 30.5, 90.0, 39.0, 0.7), (1, 50, 40, 5.0, 20.0, 6.0, 30.0, 0.6), (2, 50, 40, 0.0, 0.0, 9.0, 9.0, 0.1)]
    df = spark.createDataFrame(rows, "image int, width int, height int, x1 double, y1 double, x2 double, y2 double, score double")
    got = sorted(tuple(r) for r in ordered.suppress(df, 0.5, 5).collect())
    assert got == [(1, 0, 0, 10, 10, 0.9), (1, 30, 30, 20, 9, 0.7), (2, 0, 0, 9, 9, 0.1)]


def test_capacity_and_device_names(spark):
    rows = [(1, "a/x", "o/x", "t", "s", 10, "s", True, True, None), (2, "a/y", "o/CON.png", "t", "s", 10, "s", True, True, None), (3, "a/z", "a/z", "t", "s", 5, "s", True, True, "s")]
    df = spark.createDataFrame(rows, "k int, src string, dst string, target string, sha string, size long, src_sha string, writable boolean, same_volume boolean, dst_sha string")
    got = {r.k: r.conflicts for r in layout.resolve(layout.classify(df), 9).collect()}
    assert got == {1: ["capacity"], 2: ["capacity", "unsafe_path"], 3: ["already_correct", "capacity"]}
    empty = layout.archive_summary(layout.resolve(layout.classify(df.limit(0)), 9)).collect()
    assert len(empty) == len(layout.CONFLICTS) + 2 and all(r.n == 0 for r in empty)


def test_png_without_metadata(spark):
    chunk = lambda kind, data: struct.pack(">I4s", len(data), kind) + data + b"crc!"
    head = chunk(b"IHDR", struct.pack(">II", 7, 5) + b"\x08\x02\0\0\0")
    png = images.SIGNATURE + head + chunk(b"tEXt", b"secret") + chunk(b"IDAT", b"data") + chunk(b"IEND", b"")
    df = spark.createDataFrame([("a", png), ("b", png[:-30]), ("c", b"\xff\xd8jpeg"), ("d", b"")], "path string, content binary")
    got = {r.path: r for r in images.sanitized(df).collect()}
    assert bytes(got["a"].content) == images.SIGNATURE + head + chunk(b"IDAT", b"data") + chunk(b"IEND", b"") and (got["a"].width, got["a"].height) == (7, 5)
    assert got["b"].error and got["b"].content is None and bytes(got["c"].content) == b"\xff\xd8jpeg" and got["d"].error is None


@pytest.mark.parametrize("kind", ["long", "string"])
def test_whispers_of_large_parts_are_those_of_the_order(spark, kind):
    """Cliques, a chain whose labels run through it, a hub, ties, and a bridge between two parts."""
    r = random.Random(12)
    name = int if kind == "long" else lambda i: f"n{i:04}"
    edges = {(i, j): r.choice((0.5, 0.5, 0.25, 0.8)) for base in (0, 20, 40) for i in range(base, base + 9) for j in range(base, i)}
    edges |= {(i, i + 1): 0.5 for i in range(100, 130)} | {(200, i): 0.3 for i in range(201, 230)} | {(8, 40): 0.1, (28, 100): 0.9}
    edges |= {tuple(sorted(r.sample(range(300, 360), 2))): round(r.random(), 2) for _ in range(200)}
    rows = [(name(min(e)), name(max(e)), w) for e, w in edges.items()]
    links = spark.createDataFrame(rows, f"a {kind}, b {kind}, w double").repartition(4)
    points = spark.createDataFrame([(name(i),) for i in range(370)], f"k {kind}")
    plain = {x.k: x.cluster for x in ordered.whispers(points, links, 2).collect()}
    assert {x.k: x.cluster for x in ordered.whispers(points, links, 2, part_links=0).collect()} == plain and len(set(plain.values())) > 4
    few = {x.k: x.cluster for x in ordered.whispers(points, links, 2, rounds=2).collect()}
    assert {x.k: x.cluster for x in ordered.whispers(points, links, 2, rounds=2, part_links=40).collect()} == few


def _in_order(nodes, links, rounds):
    """Labels node by node in exact sums."""
    near, label = {}, {}
    for a, b, w in links:
        near.setdefault(a, []).append((b, round(w * ordered.STEPS)))
        near.setdefault(b, []).append((a, round(w * ordered.STEPS)))
    label = {k: k for k in nodes}
    for _ in range(rounds):
        before = dict(label)
        for k in sorted(near):
            support = {}
            for b, w in near[k]:
                support[label[b]] = support.get(label[b], 0) + w
            label[k] = min(support, key=lambda x: (-support[x], x))
        if before == label:
            break
    sizes = [label[k] for k in nodes]
    return {k: label[k] if sizes.count(label[k]) >= 2 else None for k in nodes}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_whispers_in_units_and_by_parts_are_those_of_the_order(spark, kind, monkeypatch):
    """Sparse and dense links, a hub of more links than a unit and a row, a long chain, nodes with smaller neighbours only."""
    monkeypatch.setattr(ordered, "PACKED", 16)
    r = random.Random(5)
    name = (lambda i: 7 * i - 900) if kind == "long" else lambda i: f"é{i:04}"
    edges = {tuple(sorted(r.sample(range(150), 2))): r.choice((0.25, 0.5, 1.0)) for _ in range(600)}
    edges |= {(i, i + 1): 1 - i / 1000 for i in range(200, 215)} | {(300, i): 0.4 for i in range(301, 340)} | {(i, 400): 0.5 for i in range(380, 383)}
    links = [(name(a), name(b), w) for (a, b), w in edges.items()]
    nodes = [name(i) for i in range(410)]
    df = spark.createDataFrame(links, f"a {kind}, b {kind}, w double").repartition(3)
    points = spark.createDataFrame([(k,) for k in nodes], f"k {kind}")
    for rounds in (1, 3, 20):
        want = _in_order(nodes, links, rounds)
        assert len(set(want.values())) > 4
        for options in ({}, {"part_links": 30}, {"part_links": 1}, {"part_links": 30, "sent": 0})[: 4 if rounds == 3 and kind == "long" else 2]:
            assert {x.k: x.cluster for x in ordered.whispers(points, df, 2, rounds, **options).collect()} == want


def test_whispers_of_a_large_part_are_no_rounds_of_joins(spark, monkeypatch):
    """A part of more links than a task takes is settled in units: joins would pass over all links for each step of this chain."""
    monkeypatch.setattr(ordered, "_whispered", None)
    monkeypatch.setattr(ordered, "components", None)
    links = spark.range(40).selectExpr("id a", "id + 1 b", "1 - id / 1000 w")
    got = ordered.whispers(spark.range(42).selectExpr("id k"), links, 2, part_links=20).collect()
    want = _in_order(range(42), [(r.a, r.b, r.w) for r in links.collect()], 20)
    assert {x.k: x.cluster for x in got} == want


def test_whispers_without_links(spark):
    links = spark.createDataFrame([], "a long, b long, w double")
    assert [tuple(r) for r in ordered.whispers(spark.range(1).selectExpr("id k"), links, 1).collect()] == [(0, None)]
