"""All matches, labels and scores by brute force."""

import math
import random
import re

import pytest

from tessera.llm import licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts):
    """Per text the (template, start, score) of all matches, by trying every place."""
    docs = [words(t) for t in texts]
    seen = [set(d) for d in docs]
    idf = {w: math.log((len(docs) + 1) / (sum(w in s for s in seen) + 1)) + 1e-9 for _, t, _ in licenses.TEMPLATES for w in words(t)}
    out = []
    for d in docs:
        found = []
        for k, (_, t, phrases) in enumerate(licenses.TEMPLATES):
            whole = words(t)
            parts = [words(p) for p in phrases or (t,)]
            offsets = [next(i for i in range(len(whole)) if whole[i : i + len(p)] == p) for p in parts]
            places = [[i for i in range(len(d)) if d[i : i + len(p)] == p] for p in parts]
            lead = max(range(len(parts)), key=lambda j: (sum(idf[w] for w in parts[j]), -j))
            for a in places[lead]:
                start = a - offsets[lead]
                near = []
                for j, at in enumerate(places):
                    c = [a] if j == lead else [i for i in at if abs(i - start - offsets[j]) <= licenses.SLACK]
                    near.append(min(c, key=lambda i: (abs(i - start - offsets[j]), i)) if c else None)
                if None in near or any(x >= y for x, y in zip(near, near[1:], strict=False)):
                    continue
                shifts = {n - o for n, o in zip(near, offsets, strict=True)}
                got = sum(idf[x] for j, x in enumerate(whole) if any(0 <= s + j < len(d) and d[s + j] == x for s in shifts))
                found.append((licenses.TEMPLATES[k][0], a, min(1.0, got / sum(idf[w] for w in whole))))
        out.append(found)
    return out


def cases():
    r = random.Random(8)
    texts = [t for _, t, _ in licenses.TEMPLATES] + [p for *_, ps in licenses.TEMPLATES for p in ps]
    vocab = sorted({w for t in texts for w in words(t)})
    out = [None, "", " ; ", "all rights reserved " * 40, "cc by cc by-nc CC-BY", "x " * 50_000 + "mit license", "license " * 3000]
    for _ in range(250):
        parts = [r.choice(texts) if r.random() < 0.5 else " ".join(r.choices(vocab, k=r.randint(1, 30))) for _ in range(r.randint(1, 5))]
        ws = " ".join(parts).split(" ")
        for _ in range(r.randint(0, 6)):  # words lost, changed and put in
            i = r.randrange(len(ws))
            ws[i : i + r.randint(0, 2)] = r.choices(vocab, k=r.randint(0, 3)) * r.choice((1, 1, 25))
        out.append(" ".join(ws))
    return out


def test_matches_labels_and_scores(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string").repartition(4)
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    some = set()
    for i, want in enumerate(brute(texts)):
        r = got[i]
        assert sorted((m.label, m.start) for m in r.matches) == sorted((x, a) for x, a, _ in want)
        assert sorted((m.label, m.start, round(m.score, 9)) for m in r.matches) == sorted((x, a, round(s, 9)) for x, a, s in want)
        assert r.labels == ",".join(sorted({x for x, *_ in want})) and r.score == pytest.approx(max((s for *_, s in want), default=0.0))
        some |= {x for x, *_ in want}
    assert some == {x for x, *_ in licenses.TEMPLATES}


def test_whole_licences_with_a_name_put_in():
    mit = next(t for x, t, p in licenses.TEMPLATES if x == "mit" and len(p) == 2)
    text = "Copyright (c) Some One\n" + mit.replace("THE SOFTWARE IS", "Contributed by Some One Else. THE SOFTWARE IS").replace("person obtaining", "person or body obtaining")
    index = licenses.Index({w: 5 for w in licenses.vocabulary()}, 1000)
    found = {licenses.TEMPLATES[k][0]: s for k, _, s in index.matches(licenses.words(text.encode()))}
    assert found["mit"] > 0.65
    far = mit.replace("subject to", "word " * 200 + "subject to")
    assert not [k for k, *_ in index.matches(licenses.words(far.encode())) if licenses.TEMPLATES[k][0] == "mit"]
