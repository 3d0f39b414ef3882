"""Phrases by brute force: frequencies, cuts in exact numbers, covered candidates, order; blocks of any size; odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations


def brute(docs, longest, least):
    count, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    rows = []
    for lang, f in count.items():
        cand = [g for g, a in f.items() if len(g) > 1 and a >= least]
        covered = {y[i:j] for y in cand for i in range(len(y)) for j in range(i + 2, len(y) + 1) if j - i < len(y) and f[y[i:j]] <= f[y]}
        for g in cand:
            score, k = min((1000 * f[g] * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((lang, " ".join(g), f[g], f[g[:k]], f[g[k:]], total[lang], score, g in covered))
    return rows


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["été", "x\0y", "\xa0", "Ω", "don't", "UPPER", "a-b"]
    fixed = ["new york city hall", "in spite of the", "one two one two one", "x\0y Ω", "same same same same same same"]
    rows = []
    for i in range(400):
        parts = [r.choice(fixed) if r.random() < 0.4 else " ".join(r.choice(words[: 8 + i % 29]) for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 12))]
        rows.append((r.choice(("en", "de", None, "und", "")), r.choice((". ", " ", "\n", "\t\t", ", ", "\x0b")).join(parts)))
    rows += [("a\0b", "c d " * 30), ("a", "b\0c d b\0c " * 30), ("", "1:x y " * 30), ("é", "z z " * 20), ("\U0001f600", "q r " * 30)]
    return [*rows, ("en", None), ("en", ""), (None, "  \n .."), ("de", "same " * 50_000 + "york")]


@pytest.mark.parametrize(("longest", "least", "block"), [(5, 12, 4 << 20), (3, 40, 2000), (5, 3, 300), (2, 5, 1)])
def test_candidates_by_brute_force(spark, monkeypatch, longest, least, block):
    docs = corpus()
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setitem(collocations.ARROW, "spark.sql.execution.arrow.maxRecordsPerBatch", "7" if block < 1000 else "1000")
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "lang string, text string, n int, block string, id int").repartition(3)
    got = collocations.candidates(df, longest, least).drop("words").collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, longest, least)) and len(got) > 20


def test_best_of_each_language_in_order(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    by = defaultdict(list)
    for x in brute(docs, 5, 5):
        if not x[-1]:
            by[x[0]].append(x)
    want = []
    for rows in by.values():
        rows.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        want += [(x[0], i, *x[1:7]) for i, x in enumerate(rows[:25], 1)]
    assert sorted(map(tuple, collocations.collocations(df, 5, 5, 25).collect())) == sorted(want)


def test_a_full_bitmap_and_shared_ids_give_the_same_result(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    want = sorted(brute(docs, 4, 10))
    monkeypatch.setattr(collocations, "BITS", 64)
    assert sorted(map(tuple, collocations.candidates(df, 4, 10).drop("words").collect())) == want
    told, tries = collocations._told, []

    def shared(frequent):
        tries.append(1)
        if len(tries) == 2:
            raise collocations._Shared
        return told(frequent)

    monkeypatch.setattr(collocations, "_told", shared)
    assert sorted(map(tuple, collocations.candidates(df, 4, 10).drop("words").collect())) == want and len(tries) == 6


def test_ids_and_bitmaps_are_sparks(spark):
    r = random.Random(1)
    rows = [(r.randrange(-(1 << 63), 1 << 63), r.randrange(-(1 << 63), 1 << 63)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select(F.xxhash64("a", "b").alias("id")).toPandas()["id"].to_numpy()
    a, b = (np.array(x, np.int64).view(np.uint64) for x in zip(*rows))
    assert (collocations._hash(b, collocations._hash(a)).view(np.int64) == got).all()
    bits = collocations._bitmap(df.select(F.col("a").alias("id")), 1 << 18).value
    assert collocations._passing(a, bits).all() and collocations._passing(b, bits).sum() < 5


def test_products_beyond_64_bits(spark):
    f, n, left, right = 9_000_000_000_001, 900_000_000_000_007, 9_000_000_000_003, 9_000_000_000_019
    row = spark.createDataFrame([(f, n, [left, 5 * f], [right, 3])], "f long, n long, pre array<long>, suf array<long>")
    best = row.select(collocations._cuts(2).alias("b")).select("b.*").first()
    assert (best.score, best.cut, best.l, best.r) == (1000 * f * n // (left * right), 1, left, right)
    tie = spark.createDataFrame([(100, 1000, [100, 100, 100], [100, 100, 100])], "f long, n long, pre array<long>, suf array<long>")
    assert tie.select(collocations._cuts(3)["cut"].alias("c")).first().c == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0 and collocations.collocations(none.withColumn("x", F.lit(1))).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    few = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations.collocations(few).count() == 0
