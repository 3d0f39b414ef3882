"""Anchor faces against a plain pass, over labels of any size."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence

FACES = "label string, face int, score double, hash string"


def plain(rows, least, cap, distance):
    out = {}
    for label, face, score, digits in sorted(rows, key=lambda r: (-r[2], r[1])):
        got = out.setdefault(label, [])
        near = any(digits is not None and d is not None and (int(d, 16) ^ int(digits, 16)).bit_count() <= distance for _, d in got)
        if score >= least and len(got) < cap and not near:
            got.append((face, digits))
    return {(label, face): i + 1 for label, got in out.items() for i, (face, _) in enumerate(got)}


@pytest.mark.parametrize("head", [1, 3, 512])
def test_anchors_are_those_of_a_pass(spark, head):
    """Few different hashes, so that heads are all near what is accepted, ties of scores, hashes and labels that are missing."""
    r = random.Random(7)
    base = [r.getrandbits(256) for _ in range(9)]
    rows = []
    for face in range(400):
        x = base[int(r.random() ** 3 * 9)]
        for _ in range(r.randrange(4)):
            x ^= 1 << r.randrange(256)
        rows.append((r.choice(["a", "a", "a", "b", None]), face, r.randrange(20) / 20, None if face % 67 == 0 else f"{x:064x}"))
    got = evidence.anchors(spark.createDataFrame(rows, FACES).repartition(3), 0.3, 7, 4, head)
    want = plain(rows, 0.3, 7, 4)
    assert {(x.label, x.face): x["rank"] for x in got.collect()} == want and max(want.values()) == 7


def test_a_large_label_makes_no_pairs(spark):
    """40,000 faces of a label whose hashes end alike: 800 million pairs of each of four bands."""
    began = time.time()
    d = spark.range(40_000).select(F.lit("a").alias("label"), F.col("id").cast("int").alias("face"), (1 - F.col("id") / 80_000).alias("score"), F.rpad(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), 64, "0").alias("hash"))
    assert sorted(x.face for x in evidence.anchors(d, 0.3, 20).collect()) == list(range(20))
    assert time.time() - began < 60
