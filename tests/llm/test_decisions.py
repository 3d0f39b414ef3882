"""Decisions by brute force: every labelling of small trees of pages, the language of every document of a table."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import extract, language


def consistent(parent, labels):
    """Below content stands content or what is discarded; below what is discarded nothing else."""
    return all(p < 0 or (labels[p] != 2 or x == 2) and (labels[p] != 1 or x != 0) for p, x in zip(parent, labels, strict=True))


@pytest.mark.parametrize("seed", range(25))
def test_decoded_labelling_is_the_best_of_all(seed):
    r = random.Random(seed)

    def tree(depth):
        inner = "".join(r.choice(("text words ", "more ", "", tree(depth + 1) if depth < 3 else "x ")) for _ in range(r.randint(0, 3)))
        return f"<{(t := r.choice(('div', 'section', 'span')))}>{inner}</{t}>"

    page = extract.Page(f"<body>{tree(0)}{tree(1)}</body>")
    n = len(page.tags)
    if n > 9:
        page = extract.Page(f"<body>{tree(3)}<div>a <span>b</span></div></body>")
        n = len(page.tags)
    page.features()
    odds = np.random.default_rng(seed).normal(size=n).round(3)
    weight = 1 + np.log1p(np.array(page.size, float))
    score = lambda labels: sum(odds[i] * weight[i] for i, x in enumerate(labels) if x == 1)
    best = max(score(x) for x in itertools.product(range(3), repeat=n) if consistent(page.parent, x))
    content = page.decode(odds)
    assert score(content.astype(int).tolist()) == pytest.approx(best)
    fits = [x for x in itertools.product(range(3), repeat=n) if consistent(page.parent, x) and [v == 1 for v in x] == content.tolist()]
    assert fits


def test_language_of_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    normal = lambda t: re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).lstrip()
    bodies = {k: normal(t) for k, t in language.fit(docs)}
    got = {r.doc_id: r for r in language.op2_language_id(spark, data).collect()}

    def phrases(s, body):
        at = n = 0
        while at < len(s):
            size = 0
            while at + size < len(s) and s[at : at + size + 1] in body:
                size += 1
            at += size + (at + size < len(s) and s[at + size] not in body)
            n += 1
        return n

    said = Counter()
    for r in docs.collect():
        s = normal(r.text or "")
        if not s:
            assert got[r.doc_id].lang_pred == "und"
            continue
        blocks = [s[i : i + language.BLOCK] for i in range(0, len(s), language.BLOCK)]
        rates = {k: sum(phrases(b, body) for b in blocks) * float(np.log2(max(2, len(body)))) / len(s) for k, body in sorted(bodies.items())}
        least, second = sorted(rates.values())[:2]
        assert got[r.doc_id].lang_pred == min(rates, key=rates.get)
        assert math.isclose(got[r.doc_id].score, max(0.0, 1 - least / second), abs_tol=1e-9)
        said[got[r.doc_id].lang_pred] += 1
    assert len(said) >= 3 and sum(said.values()) > 100
