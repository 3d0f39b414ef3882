"""Published revisions, undo, recovery of moves and curation on small rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation
from tessera.plans import state
from tessera.streaming import store

CHANGES = "key long, batch string, inverse_of string, revision long, position long, before string, after string, before_token long, after_token long"
STORED = "key long, before string, after string"


@pytest.mark.parametrize("name", list(state.QUERIES))
def test_has_rows(spark, data, name):
    assert state.QUERIES[name](spark, data).count()


def test_undo_keeps_later_changes_and_runs_once(spark):
    rows = [(1, "a", None, 1, 0, None, "x", None, 1), (2, "a", None, 1, 1, None, "y", None, 2), (2, "b", None, 2, 0, "y", "z", 2, 3), (2, "c", None, 3, 0, "z", "y", 3, 4)]
    plan = lambda rows: {r.key: (r.after, r.status) for r in store.undo_plan(spark.createDataFrame(rows, CHANGES), "a").collect()}
    assert plan(rows) == {1: (None, "undo"), 2: (None, "conflict")}  # key 2 is y again, but not the same y
    assert {s for _, s in plan(rows + [(1, "i", "a", 4, 0, "x", None, 1, 5)]).values()} == {"done"}
    assert plan([]) == {}


def test_snapshot_drops_what_is_gone(spark):
    c = spark.createDataFrame([(1, "a", None, 1, 0, None, "x", None, 1), (1, "b", None, 2, 0, "x", None, 1, 2)], CHANGES)
    assert [r.after for r in store.snapshot(c, 1).collect()] == ["x"] and not store.snapshot(c).count()
    assert store.replay_breaks(c, store.snapshot(c)).count() == 0


def test_two_phases(spark, tmp_path):
    r = store.Revisions(spark, str(tmp_path / "s"), STORED)
    rows = lambda v: spark.createDataFrame([(1, None, v)], STORED)
    assert r.root() == 0 and r.changes().count() == 0
    r.prepare(rows("x"), "a")
    assert r.changes().count() == 0
    with pytest.raises(RuntimeError, match="a is prepared"):
        r.prepare(rows("y"), "b")
    with pytest.raises(RuntimeError, match="root is 0"):
        r.publish("a", 3)
    assert r.publish("a", 0) == 1 and r.publish("a", 0) == 1
    with pytest.raises(RuntimeError, match="published"):
        r.abort("a")
    r.prepare(rows("y"), "b")
    r.abort("b")
    with pytest.raises(RuntimeError, match="not prepared"):
        r.publish("b", 1)
    r.prepare(rows("z"), "c")
    assert r.publish("c", 1) == 2
    assert {(c.revision, c.batch, c.after) for c in r.changes().collect()} == {(1, "a", "x"), (2, "c", "z")}


def test_a_claim_without_a_name_is_an_empty_revision(spark, tmp_path):
    r = store.Revisions(spark, str(tmp_path / "s"), STORED)
    r.prepare(spark.createDataFrame([(1, None, "x")], STORED), "a")
    (tmp_path / "s" / "log" / f"{1:020d}").touch()
    assert r.root() == 1 and r.publish("a", 1) == 2 and r.changes().count() == 1


def test_unknown_raises_uncertainty(spark):
    d = spark.createDataFrame([(1, 1.0, 1.0, 5, 1.0), (2, None, None, None, None), (3, 2.0, -0.5, 1, -1.0)], "k int, p double, m double, size int, s double")
    got = {r.k: r.u for r in d.select("k", curation.uncertainty(*(F.col(c) for c in ("p", "m", "size", "s"))).alias("u")).collect()}
    assert got == {1: pytest.approx(0.0), 2: pytest.approx(0.55 * 0.4 + 0.15 + 0.2 + 0.05), 3: pytest.approx(0.3)}


def test_conflicting_decisions_block_a_merge(spark):
    d = spark.createDataFrame([("a", "t", "confirmed"), ("b", "t", "rejected"), ("b", "u", "rejected")], "name string, tag string, decision string")
    moves = spark.createDataFrame([("b", "a")], "name string, target string")
    assert [tuple(r) for r in curation.merge_conflicts(d, moves).collect()] == [("a", "t")]


def test_merge_and_rename(spark):
    m = spark.createDataFrame([("a", ["b"], [1]), ("b", ["c"], [2, 1]), ("d", [], [3])], "name string, aliases array<string>, faces array<int>")
    moves = spark.createDataFrame([("b", "a"), ("d", "e")], "name string, target string")
    got = {r.name: (r.aliases, r.faces) for r in curation.merge_names(m, moves).collect()}
    assert got == {"a": (["b", "c"], [1, 2]), "e": (["d"], [3])}


def test_declared_size_stands_over_members(spark):
    declared = spark.createDataFrame([(1, 9, None)], "cluster long, size long, confidence double")
    faces = spark.createDataFrame([(1, 0.4), (1, 0.6), (2, None), (None, 1.0)], "cluster long, probability double")
    got = {r.cluster: (r.size, r.confidence) for r in curation.effective_clusters(declared, faces).collect()}
    assert got == {1: (9, 0.5), 2: (1, None)}


def test_recovery_of_moves_sends_no_side_to_all_workers(spark, data):
    """Sides that are estimated to be small, as the columns that are read of a wide table, hold digests of every row."""
    plan = state.move_recovery(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
