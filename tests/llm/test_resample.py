"""Importance resampling: CRCs of runs from those of words, scores and places by brute force, odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import resample
from tessera.llm.words import PLAIN, SPACED, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("longest", [1, 2, 5])
def test_crcs_of_runs_are_those_of_their_strings(longest):
    r = random.Random(longest)
    texts = [None, "", "one", "a B", "É 北京 ÀB x9", "y" * 5000 + " z " + "w" * 70_000] + ["".join(r.choice("abC dé,9 ß\0`") for _ in range(r.randrange(80))) for _ in range(60)]
    ends, runs = resample.run_crcs(pa.array(texts), longest)
    for n, (crcs, at) in enumerate(runs, 1):
        want = [[zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)] for w in map(words, texts)]
        bounds = np.searchsorted(at, ends)
        assert [crcs[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_words_of_slices_and_pieces():
    texts = pa.array(["zero, one", "two three. four", None, "", "five\nsix"]).slice(1)
    w = split(texts, SPACED)
    assert [w.distinct[c].as_py().decode() for c in w.codes] == ["two", "three.", "four", "five", "six"] and w.ends.tolist() == [0, 3, 3, 3, 5]
    assert w.lengths().tolist() == [3, 6, 4, 4, 3]
    assert [split(pa.array([], pa.string()), PLAIN).ends.tolist(), split(pa.array([None, ""]), PLAIN).ends.tolist()] == [[0], [0, 0, 0]]


def brute(docs, target, longest, buckets, seed, percent, least):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams(text))
        out.append((i, len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    ranked = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = percent * len(ranked) // 100
    place = [(*x[:4], i + 1 if i < drawn else None) for i, x in enumerate(ranked)] + [(*x[:4], None) for x in out if x[4] < least]
    return sorted(map(str, place)), sorted(str(x[0]) for x in ranked[:drawn])


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97)])
def test_scores_and_places_by_brute_force(spark, longest, buckets):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(90)]
    docs = [(i, " ".join(r.choice(vocabulary[: 30 + i % 60]) for _ in range(r.randrange(60))).title()) for i in range(300)] + [(1000, None), (1001, ""), (1002, "!! ..."), (None, " ".join(vocabulary)), (7, " ".join(vocabulary[:25])), (1003, "word " * 30_000)]
    target = [" ".join(r.choice(vocabulary[:20]) for _ in range(40)) for _ in range(30)] + [None, ""]
    d = spark.createDataFrame([(*x, "a", 1, 2) for x in docs], "doc_id long, text string, score string, place int, w int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    rows, drawn = brute(docs, target, longest, buckets, 11, 20, 15)
    settings = {"longest": longest, "buckets": buckets, "seed": 11, "percent": 20, "least": 15}
    got = resample.importance(d, t, **settings)
    assert sorted(str((x.doc_id, x.n_features, x.weight, x.score, x.rank)) for x in got.collect()) == rows
    kept = resample.resampled(d, t, **settings)
    assert kept.columns == d.columns and sorted(str(x.doc_id) for x in kept.collect()) == drawn and len(drawn) > 40


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.importance(none, none).count() == 0 and resample.resampled(none, none).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 40, "doc_id long, text string")
    got = resample.importance(same, none, least=3).collect()
    assert sorted(x.rank for x in got if x.rank) == [1, 2, 3, 4] and len({(x.weight, x.score) for x in got}) == 1
