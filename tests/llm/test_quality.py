"""Fences and verdicts against a brute-force sketch and exact quantiles."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rated(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(g)
    again = len({k + j for k, x in enumerate(g) if c[x] > 1 for j in range(3)})
    chars, n = sum(map(len, w)), len(w)
    failed = n < 50 or 100 * again > 50 * n
    return failed, {"symbol_share": len(re.findall(r"[#*$%&|<>]", t)) / max(chars, 1), "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_share": again / max(n, 1), "word_length": chars / max(n, 1)}


def sketched(values, p):
    """The sketch's quantile of a list."""
    b = sorted(quality.ZERO if v <= 0 else math.ceil(math.log(v) / math.log(quality.GAMMA)) for v in values)[math.floor(p * (len(values) - 1))]
    return 0.0 if b == quality.ZERO else quality.GAMMA**b * 2 / (quality.GAMMA + 1)


def fences(groups, key):
    """The fences of a group by hand: own values, else the language's, else all."""
    lang = key[0]
    levels = [groups.get(key, []), [v for k, vs in groups.items() if k[0] == lang for v in vs], [v for vs in groups.values() for v in vs]]

    def q(c, p, some=False):
        for i, level in enumerate(levels):
            values = [v[c] for v in level if not some or v[c] > 0]
            if len(values) >= quality.FEW or i == 2:
                return sketched(values, p) if values else 0.0

    spread = lambda c, some: max((q(c, 0.75, some) - q(c, 0.25, some)) * quality.REACH, quality.FLOORS[c])
    most = {c: q(c, 0.75, True) + spread(c, True) for c in ("dup_line_share", "repeat_share")}
    most["symbol_share"] = q("symbol_share", 0.75) + max(spread("symbol_share", False), q("symbol_share", 0.25, True) / 2)
    most["word_length"] = q("word_length", 0.75) + spread("word_length", False)
    return most, q("word_length", 0.25) - spread("word_length", False)


def judged(rows):
    """doc_id -> (base_failed, over) by brute force."""
    of, groups = {i: rated(t) for i, t, *_ in rows}, defaultdict(list)
    for i, _, lang, source in rows:
        if not of[i][0]:
            groups[lang, source].append(of[i][1])
    known, out = {}, {}
    for i, _, lang, source in rows:
        if (lang, source) not in known:
            known[lang, source] = fences(groups, (lang, source))
        (most, least), v = known[lang, source], of[i][1]
        over = [c for c in quality.FLOORS if v[c] > most[c]] + ["short_words"] * (v["word_length"] < least)
        out[i] = (of[i][0], ",".join(over))
    return out


@pytest.mark.parametrize("few", [200, 15])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_verdicts_by_brute_force(spark, data, monkeypatch, few, broadcast):
    monkeypatch.setattr(quality, "FEW", few)
    monkeypatch.setattr(quality, "BROADCAST", broadcast)
    monkeypatch.setattr(quality, "HOT_ROWS", 20)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(90_000 + i, t, lang, s) for i, (t, lang, s) in enumerate([(None, None, None), ("", "en", None), ("w " * 60, None, "x"), (" | ".join(f"a{i}b" for i in range(90)), "-", "1:x"), ("line of words\n" * 30, "", ""), ("x" * 400_000, "en", "web")])]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    want = judged([tuple(r) for r in docs.collect()])
    for _ in range(2):  # the same in every run
        got = {r.doc_id: (r.base_failed, r.over, r.kept) for r in quality.quality(docs.repartition(7)).collect()}
        assert got == {i: (f, o, not f and not o) for i, (f, o) in want.items()}


def test_sketches_are_as_exact_as_said(spark):
    r = np.random.default_rng(3)
    rows = [(f"l{i % 2}", f"s{i % 3}", 100, 0, float(v), 0.0, float(r.random() ** 8), float(1 + v)) for i, v in enumerate(r.lognormal(-3, 2, 6000))]
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, n_repeat_words long, symbol_share double, dup_line_share double, repeat_share double, word_length double")
    at = {"symbol_share": 4, "some_symbol_share": 4, "dup_line_share": 5, "repeat_share": 6, "some_repeat_share": 6, "word_length": 7}
    sketch = quality.sketches(df)
    for keys in ((), ("lang",), ("lang", "source")):
        for q in quality.quartiles(sketch, *keys).collect():
            mine = [x[at[q.m]] for x in rows if all(x[("lang", "source").index(k)] == q[k] for k in keys)]
            for p, v in ((0.25, q.q25), (0.75, q.q75)):
                exact = float(np.quantile(mine, p, method="lower"))
                assert q.n == len(mine) and abs(v - exact) <= 1.0001 * quality.ACCURACY * exact
