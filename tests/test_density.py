"""Density trees on blobs whose clusters are known, and the spanning tree against all edges."""

import numpy as np
import pytest
from tessera.operators import density, metric


def blobs(sizes, seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([np.eye(8)[i] + r.normal(0, 0.02, (n, 8)) for i, n in enumerate(sizes)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_spanning_tree_weight():
    x = blobs([9, 8, 7], 4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    root, total = list(range(len(x))), 0.0
    for w, i, j in sorted((reach[i, j], i, j) for i in range(len(x)) for j in range(i)):
        if root[i] != root[j]:
            root, total = [root[j] if r == root[i] else r for r in root], total + w
    assert density.spanning_tree(x, 4)[:, 0].sum() == pytest.approx(total)


def test_two_blobs_and_outliers(spark):
    x = np.concatenate([blobs([6, 6]), -np.eye(8)[:2]])
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, k int, v array<double>")
    got = {r.k: (r.cluster, r.prob) for r in density.density_tree(df, 5).collect()}
    assert [got[i][0] for i in range(14)] == [0] * 6 + [6] * 6 + [None] * 2
    assert all(0 < got[i][1] <= 1 for i in range(12)) and got[12][1] == got[13][1] == 0
    assert max(got[i][1] for i in range(6)) == 1.0


def test_small_and_equal_groups(spark):
    rows = [("few", i, [1.0, 0.0]) for i in range(3)] + [("same", i, [1.0, 0.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>")
    assert density.density_tree(df, 5).filter("g = 'few' AND cluster IS NOT NULL").count() == 0
    assert density.density_tree(df, 5).count() == 15


@pytest.mark.parametrize("kind", ["int", "string"])
def test_distributed_tree_is_as_light_as_the_plain_one(spark, monkeypatch, kind):
    """Blobs of several densities, copies and outliers, in cells of few rows."""
    monkeypatch.setattr(metric, "CELL", 16)
    monkeypatch.setattr(metric, "HELD", 64)
    x = np.concatenate([blobs([60, 50, 40, 30], 5), np.tile(np.eye(8)[5], (20, 1)), -np.eye(8)[:3]])
    keys = [i if kind == "int" else f"k{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], f"k {kind}, v array<double>").repartition(4)
    edges = density.tree_edges(df, 5).collect()
    want = density.spanning_tree(x, 5)
    at = {k: i for i, k in enumerate(keys)}
    children, heights, _ = density.linked(np.array(sorted((e.w, at[e.a], at[e.b]) for e in edges)), len(x))
    assert len(children) == len(x) - 1 and sorted(heights) == pytest.approx(want[:, 0].tolist(), abs=1e-7)


def test_large_groups_have_the_clusters_of_small_ones(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL", 16)
    x = np.concatenate([blobs([70, 60, 50], 6), -np.eye(8)[:4]])
    rows = [(g, i, v.tolist()) for g in ("a", "b", None) for i, v in enumerate(x[: 90 if g == "b" else len(x)])]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>")
    plain = {(r.g, r.k): (r.cluster, r.prob) for r in density.density_tree(df, 5).collect()}
    large = {(r.g, r.k): (r.cluster, r.prob) for r in density.density_tree(df, 5, small=100).collect()}
    assert plain.keys() == large.keys() and len({c for c, _ in plain.values()}) > 2
    assert {k: c for k, (c, _) in plain.items()} == {k: c for k, (c, _) in large.items()}
    assert {k: (p, large[k][1]) for k, (_, p) in plain.items() if abs(p - large[k][1]) > 1e-6} == {}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_tree_of_blocks_is_the_plain_one_in_one_pass(spark, monkeypatch, kind):
    """Vectors without clusters, some of them copies, whose cells can all meet: trees of blocks, united in several steps."""
    monkeypatch.setattr(density, "BLOCK", 40)
    monkeypatch.setattr(density, "UNITED", 3)
    monkeypatch.setattr(metric, "CELL", 16)
    monkeypatch.setattr(density, "units", lambda *a, units=density.units, seen=[]: seen.append(1) or units(*a) if not seen else pytest.fail("all pairs are met in rounds"))
    x = np.random.default_rng(3).normal(size=(300, 8))
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.tile(np.eye(8)[2], (20, 1))])
    keys = [i if kind == "int" else f"k{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], f"k {kind}, v array<double>").repartition(4)
    at = {k: i for i, k in enumerate(keys)}
    got = sorted((e.w, at[e.a], at[e.b]) for e in density.tree_edges(df, 5).collect())
    want = density.spanning_tree(x, 5)
    assert [e[1:] for e in got] == [(int(a), int(b)) for _, a, b in want]
    assert [e[0] for e in got] == pytest.approx(want[:, 0].tolist(), abs=1e-12)
