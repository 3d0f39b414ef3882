"""Operators, sources and sinks on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import grouping, inventory, neardup, policy, ranking
from tessera.sources import sinks, tables
from tessera.streaming import events


def test_tier_boundaries(spark):
    """21 rows, four equal signals: only the ends get decided tiers, and the audit sample goes back to review."""
    rows = [(i, f"{i + 100:08x}" + "0" * 56, f"f{i}", *[float(i)] * 4, 0.9, None, 0.1, None) for i in range(21)]
    df = spark.createDataFrame(rows, "position int, sha256 string, family_id string, a double, b double, c double, d double, identity_sim double, confusable_margin double, nsfw_prob double, gaming_delta double")
    got = {r.position: (r.proposed_tier, r.flags) for r in ranking.tiers(df, ["a", "b", "c", "d"]).collect()}
    assert got[14][0] == "archive_candidate" and got[15][0] == got[17][0] == "review" and got[18][0] == "queue"
    assert got[0] == ("review", "audit_sample")


def test_sigma_disagreement(spark):
    rows = [(i, float(i), float(i), 6.0553007081949835) for i in range(21)]
    df = spark.createDataFrame(rows, "position int, a double, b double, s double")
    got = ranking.consensus(df, ["a", "b"], ("s", "b")).select("disagreement").distinct().collect()
    assert len(got) == 1 and got[0][0] == pytest.approx(0.5**0.5)


def test_one_missing_signal_silences_the_cohort(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "position int, a double, b double")
    assert all(r.consensus_z is None and r.disagreement is None for r in ranking.consensus(df, ["a", "b"]).collect())


def test_empty_cohort(spark):
    df = spark.createDataFrame([], "position int, a double")
    assert ranking.consensus(df, ["a"]).count() == 0


def test_banded_pairs_are_exact(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    xs = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base]
    df = spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(xs)], "k int, h string")
    got = {(p.a, p.b, p.distance) for p in neardup.banded_pairs(df, "k", "h", 10, digits=16, band=1).collect()}
    assert got == {(i, j, (xs[i] ^ xs[j]).bit_count()) for i in range(len(xs)) for j in range(i + 1, len(xs)) if (xs[i] ^ xs[j]).bit_count() <= 10}


def test_components_of_a_path(spark):
    n = 60
    nodes = spark.range(n).select(F.col("id").alias("k"))
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 30], "a long, b long")
    got = {r.k: r.component for r in neardup.components(nodes, links).collect()}
    assert all(got[i] == (0 if i <= 30 else 31) for i in range(n))


@pytest.mark.parametrize(("x", "n", "p", "low", "high"), [(30, 30, 100, 0.8864829086, 1.0)])
def test_wilson(spark, x, n, p, low, high):
    r = spark.range(1).select(scalars.wilson(F.lit(x), F.lit(n), F.lit(p)).alias("w")).first().w
    assert (r.value, r.low, r.high) == (1.0, pytest.approx(low), pytest.approx(high))


def test_wilson_census_and_nothing(spark):
    r = spark.range(1).select(scalars.wilson(F.lit(27), F.lit(30), F.lit(30)).alias("c"), scalars.wilson(F.lit(None).cast("int"), F.lit(3), F.lit(9)).alias("n"), scalars.wilson(F.lit(0), F.lit(0), F.lit(9)).alias("z")).first()
    assert r.c.method == "census-exact" and r.c.low is None and r.c.value == 0.9 and r.n.method == r.z.method == "unavailable"


def test_coherence_keeps_the_missing(spark):
    rows = [("g", i, [1.0, 0.0]) for i in range(2)] + [("g", 2, [0.0, 0.0]), ("g", 3, None)]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>").withColumn("v", scalars.unit(F.col("v")))
    r = grouping.loo_coherence(df, 2).first()
    assert (r.denominator, r.valid, r.missing, r.median) == (4, 2, 2, pytest.approx(1.0))


def test_first_pass_boundaries(spark):
    base = (2, True, True, [], None, None, True)
    rows = [("yes", *base, 0.90, 0.05), ("sim", *base, 0.899999, 0.05), ("margin", *base, 0.90, 0.049999)]
    df = spark.createDataFrame(rows, "k string, rivals int, supported boolean, calibrated boolean, conflicts array<string>, model_score double, model_next double, model_agrees boolean, sim double, margin double")
    got = {r.k: (r.tier, r.reasons) for r in policy.first_pass(df).collect()}
    assert got == {"yes": ("auto", "reference-gates-passed"), "sim": ("review", "similarity-below-policy"), "margin": ("review", "margin-below-policy")}
    assert all(r.tier == "review" for r in policy.first_pass(df, human_first=True).collect())


def test_audit_size(spark):
    df = spark.createDataFrame([("auto", f"i{i}") for i in range(21)] + [("none", "x")], "tier string, k string")
    got = policy.audit(df, "s").groupBy("tier").count().collect()
    assert {r.tier: r["count"] for r in got} == {"auto": 2, "none": 1}


def test_undo_takes_back_the_latest(spark):
    log = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "undo"), ("b", 1, "x"), ("b", 2, "undo"), ("c", 1, "x"), ("c", 2, "undo"), ("c", 3, "y"), ("d", 1, "x"), ("d", 2, "y"), ("d", 3, "undo"), ("d", 4, "undo"), ("d", 5, "z")]
    got = {r.k: r.action for r in events.undone(spark.createDataFrame(log, "k string, seq int, action string")).collect()}
    assert got == {"a": "x", "c": "y", "d": "z"}


def test_stream_counts_like_the_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = events.stream_latest(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "user_id", "event_id", "ts", "3650 days")
    q = s.writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("live").agg(F.sum("n")).first()[0] == e.count()


def test_tolerant_scores(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("sha16,aes,flags,proposed_tier\n a ,0.5,x| |x|y,\nb,,,queue\n")
    got = {r.sha16: r for r in tables.scores_csv(spark, str(p), ["aes", "nsfw"]).collect()}
    assert got["a"].flags == ["x", "y"] and got["a"].proposed_tier == "review" and got["b"].aes is None and got["b"].nsfw is None and got["b"].family_id == "unassigned"
    p.write_text("sha16,aes\na,inf\n")
    with pytest.raises(Exception, match="not a finite number"):
        tables.scores_csv(spark, str(p), ["aes"]).collect()


def test_sinks(spark, tmp_path):
    images = spark.createDataFrame([("i",), ("j",)], "image string")
    roles = spark.createDataFrame([("i", "b"), ("i", "a"), ("i", "a")], "image string, role string")
    out = sinks.by_image(images, roles)
    assert {r.image: r.roles for r in out.collect()} == {"i": "a|b", "j": ""}
    sinks.export_csv(out, ["roles", "absent", "image"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["roles", "absent", "image"]
    assert [sinks.add_new(images, str(tmp_path / "t"), "image") for _ in range(2)] == [2, 2]


def test_fail_closed(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert inventory.violations(df, {"known": F.col("x").isNotNull(), "small": F.col("x") < 5}).collect() == [("known", 1), ("small", 1)]
    with pytest.raises(Exception, match="broken rule: small"):
        inventory.fail_closed(df, {"small": F.col("x") < 5}).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.PNG").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    (tmp_path / "a/y.txt").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in tables.image_files(spark, str(tmp_path)).collect()] == ["x.PNG"]
    assert tables.hashed_files(spark, str(tmp_path)).filter("signature = '89504E470D0A1A0A'").count() == 1


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("small", [4096, 8])
def test_pairs_within_a_distance(spark, monkeypatch, small):
    """One cell or many, hot cells, copies, keys of two kinds, empty tables: all pairs once."""
    import numpy as np

    from tessera.operators import metric

    monkeypatch.setattr(metric, "SMALL", small)
    monkeypatch.setattr(metric, "CELL", 7)
    monkeypatch.setattr(metric, "HELD", 20)
    monkeypatch.setattr(metric, "PASSING", 50)
    r = np.random.default_rng(4)
    m = np.concatenate([r.normal(size=(90, 6)), np.tile(r.normal(size=(1, 6)), (25, 1)), r.normal(size=(60, 6)) * 0.1 + 1])
    m /= np.linalg.norm(m, axis=1)[:, None]
    for name in (str, int):
        keys = [name(i + 100) for i in range(len(m))]
        points = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, m, strict=True)], f"k {'string' if name is str else 'int'}, v array<double>").repartition(3)
        for least in (0.5, 0.95):
            want = {(keys[i], keys[j]) for i in range(len(m)) for j in range(i + 1, len(m)) if m[i] @ m[j] >= least}
            got = metric.similar_pairs(points, least).collect()
            assert len(got) == len(want) and {(p.a, p.b) for p in got} == want
    assert metric.similar_pairs(points.limit(0), 0.5).count() == 0
    bits = [int(x) for x in r.integers(0, 2**62, 60)] + [(1 << 90) + (1 << int(x)) for x in r.integers(0, 20, 40)]
    rows = spark.createDataFrame([(i, f"{x:032x}") for i, x in enumerate(bits)], "k int, v string")
    for within in (2, 26):
        want = {(i, j, (bits[i] ^ bits[j]).bit_count()) for i in range(100) for j in range(i + 1, 100) if (bits[i] ^ bits[j]).bit_count() <= within}
        assert {tuple(p) for p in metric.hamming_pairs(rows, within).collect()} == want


def test_few_cells_are_multiplied_where_vectors_lie_in_clusters(spark):
    import numpy as np

    from tessera.operators import metric

    r = np.random.default_rng(0)
    centres = r.normal(size=(120, 16))
    x = centres[r.integers(0, 120, 6000)] + r.normal(size=(6000, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    _, *cells = metric.celled(points, metric.COSINE)
    n = len(cells[0])
    met = metric.meeting_cells(spark, metric.COSINE, *cells, float(np.sqrt(2 - 2 * 0.95))).count()
    assert n <= 6000 / metric.CELL + metric.PIVOTS + 1 and met < n * (n + 1) / 2 / 10
    assert metric.similar_pairs(points, 0.95).count() == np.triu(x @ x.T >= 0.95, 1).sum()


def test_block_products(spark, monkeypatch):
    """A right side that is sent, and blocks of any size, give each pair once."""
    import numpy as np
    import pandas as pd

    from tessera.operators import blocks

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "k int, v array<double>").repartition(3)

    def run(x, y):
        s = blocks.matrix(x["v"]) @ blocks.matrix(y["v"]).T if len(x) and len(y) else np.empty((0, 0))
        i, j = np.nonzero(s >= 0)
        return pd.DataFrame({"a": x["k"].to_numpy()[i], "b": y["k"].to_numpy()[j], "s": s[i, j]})

    want = sorted((i, j, i * j + 1.0) for i in range(40) for j in range(40))
    for sent in (8192, 0):
        monkeypatch.setattr(blocks, "SENT", sent)
        got = blocks.products(df, df, ("k", "k"), run, "a int, b int, s double", 7).collect()
        assert sorted(map(tuple, got)) == want


def test_the_large_side_of_a_product_is_moved_once_a_unit(spark, monkeypatch):
    """Shuffled rows grow with the rows held by a task, not with pairs of blocks, and a task folds what it returns."""
    from tessera.operators import blocks, grouping

    x = [(i, "abc"[i % 3], [float((i * 7 + j * 5) % 11 - 5) for j in range(4)]) for i in range(200)]
    d = spark.createDataFrame([(k, g, [c / sum(c * c for c in v) ** 0.5 for c in v]) for k, g, v in x], "k long, label string, v array<double>").repartition(3)
    bank = d.select("label", F.col("k").alias("crop"), "v")
    scores = lambda: {(r.k, r.label): (r.centre, r.individual) for r in grouping.label_scores(d.select("k", F.col("k").alias("crop"), "v"), bank, 4).collect()}
    want = scores()
    monkeypatch.setattr(blocks, "SENT", 0)
    monkeypatch.setattr(blocks, "PASSING", 16)
    monkeypatch.setattr(blocks, "HELD", 70)
    assert {k: pytest.approx(v) for k, v in want.items()} == scores() and len(want) == 600
    run = lambda p, q: p[["k"]].assign(n=len(q))
    got = blocks.products(d.select("k"), d.select("k"), ("k", "k"), run, "k long, n long", 10, lambda p: p.groupby("k", as_index=False).sum())
    assert {r.n for r in got.collect()} == {200} and got.count() == 200  # 20 blocks of 10 rows, each of which gave a row for each block before


def test_places_and_quantiles(spark):
    import numpy as np

    from tessera.operators import skew

    r = np.random.default_rng(5)
    rows = [(("a", "b", "c")[i % 7 % 3], float(v) if i % 11 else None) for i, v in enumerate(r.integers(0, 40, 300))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    q = skew.quantiles(df, "v", {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p100": 1.0}).first()
    mine = [v for _, v in rows if v is not None]
    assert [q.p0, q.p10, q.p50, q.p100] == pytest.approx(np.quantile(mine, [0, 0.1, 0.5, 1]).tolist())
    for x in skew.group_quantiles(df, ["g"], "v", {"p10": 0.1, "p95": 0.95}).collect():
        assert [x.p10, x.p95] == pytest.approx(np.quantile([v for g, v in rows if g == x.g and v is not None], [0.1, 0.95]).tolist())
    got = skew.placed(df.filter("v IS NOT NULL"), F.desc("v"), "g").sort("place").collect()
    assert [x.place for x in got] == list(range(len(mine))) and [(x.v, x.g) for x in got] == sorted(((v, g) for g, v in rows if v is not None), key=lambda x: (-x[0], x[1]))
    assert skew.quantiles(df.limit(0), "v", {"p": 0.5}).first().p is None


def test_hot_bands_give_the_same_pairs(spark, monkeypatch):
    """Strings that share bands of zeros, by bands alone and with all of them hot."""
    import random

    r = random.Random(3)
    bits = [sum(1 << r.randrange(40) for _ in range(3)) for _ in range(60)] + [r.getrandbits(256) for _ in range(20)]
    bits += [b ^ (1 << r.randrange(256)) for b in bits]
    rows = spark.createDataFrame([(i, f"{b:064x}") for i, b in enumerate(bits)], "k int, x string")
    want = {(i, j, (bits[i] ^ bits[j]).bit_count()) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (bits[i] ^ bits[j]).bit_count() <= 5}
    for hot in (4096, 10):
        monkeypatch.setattr(neardup, "HOT_BAND", hot)
        got = neardup.banded_pairs(rows, "k", "x", 5).collect()
        assert {tuple(p) for p in got} == want and len(got) == len(want) > 60


def test_theta_families_fold_copies(spark):
    """Copies of one hash make a family without pairs; the wider distance needs one pair of close vectors."""
    h = lambda *bits: f"{sum(1 << b for b in bits):064x}"
    rows = [(i, f"s{i % 2}", h(), [1.0, 0.0]) for i in range(40)] + [(50, "s50", h(1, 2, 3), [0.0, 1.0]), (60, "s60", h(*range(100, 108)), [1.0, 0.0]), (70, "s70", h(*range(150, 158)), [0.0, 1.0]), (80, "s80", None, None), (81, "s80", None, [1.0, 0.0]), (90, "s90", h(*range(20)), [1.0, 0.0])]
    got = {r.k: r.component for r in neardup.theta_families(spark.createDataFrame(rows, "k int, sha256 string, hash string, v array<double>")).collect()}
    assert got == {i: 0 for i in range(40)} | {50: 0, 60: 0, 70: 70, 80: 80, 81: 81, 90: 90}
