"""The text operators against brute force, and on null, empty, repeated and clashing rows."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, extract, language, licenses, pieces, quality, simhash, suffix_dedup, urls, warc
from tessera.llm.suffix_array import permuted_lcp, suffix_array

ODD = [(10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, "ab" * 400), (10_004, "x" * 350), (10_005, "A b"), (10_006, "a b c"), (10_007, "all rights reserved " * 40), (10_008, "é" * 130 + "日本 " * 80), (10_009, "All Rights Reserved; CC-BY. General  PUBLIC\nlicense")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, did string, b string, h int, label int, component_id int"


@pytest.fixture(scope="module")
def rows(spark, data):
    got = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    return got + [(i, t, None, None) for i, t in ODD]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns with clashing names, dealt over partitions."""
    return spark.createDataFrame([(*r, 0, 1, "x", "y", 2, 3, 4) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


@pytest.mark.parametrize("wide", [0, 3, 512])
def test_suffix_arrays(monkeypatch, wide):
    from tessera.llm import suffix_array as module

    monkeypatch.setattr(module, "WIDE", wide)
    r = np.random.default_rng(1)
    for i in range(400):
        u = r.integers(1, r.integers(2, 6), r.integers(0, 40))
        t = np.concatenate((np.tile(u, 1 + i % 3), [0])).astype(np.uint16)
        sa, x = suffix_array(t), t.tolist()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        plcp = permuted_lcp(t, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            assert plcp[b] == k


@pytest.mark.parametrize("big", [20_000, 1])
def test_op9(docs, rows, big):
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for s in range(len(b) - 99):
            if (w := b[s : s + 100]) in seen:
                cut[s : s + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(c for c, x in zip(b, cut, strict=True) if not x)
        want[i] = (len(b), sum(cut), sum(1 for j, x in enumerate(cut) if x and (not j or not cut[j - 1])), hashlib.sha256(rest).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, big=big).collect()} == want


def print_of(t):
    w = low(t).encode().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(g))


@pytest.mark.parametrize("block", [4096, 4])
def test_op10(docs, rows, block):
    fp = {i: print_of(t) for i, t, *_ in rows}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, block=block).collect()}
    assert got == {i: (fp[i], find(i)) for i in ids}


def test_op10_thresholds_cover_the_distance():
    r = np.random.default_rng(5)
    for n in (0, 2, 1000, 10**9):
        x = r.random((64, 64))
        xx = n * (x @ x.T) / 64
        plan = simhash.allocate(n, xx, 3)
        assert sum(t + 1 for _, t in plan) == 4 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_op1(docs, rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w, at = words(t), []
        for p, label in phrases.items():
            p = p.split()
            at += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op2(docs, rows):
    got = {r.doc_id: r for r in language.language_id(docs).collect()}
    right = [got[i].lang_pred == lang for i, t, lang, _ in rows if lang and len(t) > 200 and got[i].held_out]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    for i, t, *_ in rows:
        assert got[i].held_out == (crc32(str(i).encode()) % 4 == 2)
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_op2_counts_longest_matches():
    m = language.Model({"a": "the cat sat on the mat", "b": "der hund sass auf der matte"})
    text = "the hund sat auf the mat"
    got, _ = m.phrases([text])
    for k, lang in enumerate(m.langs):
        base, at, n = "".join({"a": "the cat sat on the mat", "b": "der hund sass auf der matte"}[lang]), 0, 0
        while at < len(text):
            size = 0
            while at + size < len(text) and text[at : at + size + 1] in base:
                size += 1
            at += size + (at + size < len(text) and text[at + size] not in base)
            n += 1
        assert int(got[0, k]) == n


def test_pipeline_keeps_letters_where_nothing_is_labelled(docs, rows):
    some = docs.filter("doc_id < 100 OR doc_id >= 10000").withColumn("lang", F.lit(None).cast("string"))
    got = sorted(r.doc_id for r in language.with_language(some).collect())
    assert got == sorted(i for i, t, *_ in rows if (i < 100 or i >= 10_000) and any(c.isalpha() for c in t or ""))


def test_op2_letters_beyond_the_dense_table():
    rng = np.random.default_rng(1)
    alphabets = {"la": [97, 26], "ru": [0x430, 32], "zh": [0x4E00, 400], "zi": [0x4E00 + 200, 400], "ko": [0xAC00, 300]}  # zh and zi share half
    vocabulary = {k: ["".join(chr(a + i) for i in rng.integers(0, n, rng.integers(1, 4))) for _ in range(300)] for k, (a, n) in alphabets.items()}
    say = lambda k, n: "".join(w + (" " if rng.random() < 0.3 else "") for w in rng.choice(vocabulary[k], n))
    sample = {k: say(k, 1500) for k in alphabets}
    m = language.Model(sample)
    texts = [say(k, 40) for k in alphabets for _ in range(5)] + ["жук Ω 一二三 𠀀 abc", "Ω", "", "12"]
    assert m.predict(texts)[0][:25] == [k for k in alphabets for _ in range(5)]
    got, _ = m.phrases(texts)
    normal = lambda t: re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).lstrip()
    for k, lang in enumerate(m.langs):
        body = normal(sample[lang])
        for t, n in zip(texts, got[:, k], strict=True):
            s, at, phrases = normal(t), 0, 0
            while at < len(s):
                size = 0
                while at + size < len(s) and s[at : at + size + 1] in body:
                    size += 1
                at += size + (at + size < len(s) and s[at + size] not in body)
                phrases += 1
            assert n == phrases


def test_op3(docs, rows, spark, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()] + [(900, "a b"), (901, None), (902, "a b")]
    got = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


def test_op3_beyond_the_broadcast(docs, spark, data, monkeypatch):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contamination(docs, items).drop("spans").collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).drop("spans").collect())) == want


def test_op5(docs, rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = word.findall(t or "")
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(g)
        again = {k + j for k, x in enumerate(g) if c[x] > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_op5_fences_follow_the_groups(spark):
    rows = []
    for lang, symbol in (("a", 0.1), ("b", 0.3)):  # a twelfth of each language's texts are junk of its own strength
        for i in range(3000):
            share = symbol + i % 5 / 100 if i % 12 == 0 else 0.0
            rows.append((len(rows), lang, "s", 100, 0, share, i % 10 / (50 if lang == "a" else 25), i % 20 / 200, 5 + i % 9 / (20 if lang == "a" else 10)))
    rated = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, n_repeat_words long, symbol_share double, dup_line_share double, repeat_share double, word_length double")
    a, b = sorted(quality.thresholds(rated).collect(), key=lambda r: r.lang)
    assert 0.04 < a.most_symbol_share < 0.1 < b.most_symbol_share < 0.2
    assert a.most_dup_line_share < b.most_dup_line_share and a.most_word_length < b.most_word_length and a.least_word_length > b.least_word_length


def test_op5_lists_split_by_pipes(spark):
    text = lambda i, by: by.join(f"wo{i % 7}rd{k * (i + 1)} te{k}xt" for k in range(60))
    some = [(i, text(i, " | " if i % 20 == 0 else " "), "en", f"s{i % 3}") for i in range(600)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(some, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept == (i % 20 > 0) and not got[i].base_failed for i in got)


def test_op4():
    g, trees = extract.Generator(1234), extract.model()
    wrong = 0
    for _ in range(60):
        page = g.page()
        body = extract.Page(page[page.index("\x01") + 1 : page.index("\x02")])
        want = body.text(np.ones(len(body.tags), bool))
        wrong += extract.main_texts([page.replace("\x01", "").replace("\x02", "")], trees)[0] != want
    assert wrong <= 2


def test_op4_supplied_pages(spark, data):
    import html

    for r in extract.extract(spark.read.parquet(f"{data}/pages.parquet")).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        a = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", a))
        assert r.text == " ".join(html.unescape(a).split()) and r.n_chars == len(r.text)


def test_op4_consistent_and_odd(spark):
    page = extract.Page("<div><p>a</p><div><p>b</p></div></div>")
    page.features()
    label = page.decode(np.array([-1.0, -5.0, 3.0, -5.0, 4.0]))
    assert all(not (label[k] and not label[p] and any(label[q] for q in [page.parent[p]] if q >= 0)) for k, p in enumerate(page.parent) if p >= 0)
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "u", "<"), (4, "u", "<div><p>" * 300), (5, "u", "a" * 300_000), (6, "u", "<script>x")], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in extract.extract(odd).collect()}.keys() == {1, 2, 3, 4, 5, 6}


def test_op6(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    tokens = pieces.tokenize(docs)
    got = {r.doc_id: r for r in tokens.collect()}
    back = {r.doc_id: r.text for r in pieces.detokenize(tokens).collect()}
    for i, t, *_ in rows:
        assert list(got[i].ids or []) == sp.encode(t or "") and got[i].round_trip and back[i] == (t or "")


@pytest.mark.parametrize("text", [" a  b\n\nc\td ", "ﬁ Å é", "日本x<s>", "\U0001f600 ok\U0001f600", "    " * 9 + "x", "a" * 99, "foo_bar   = 1;\n\t\tif (x) {\n"])
def test_op6_like_the_library(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert np.frombuffer(pieces.opened(pieces.default_model()).encode([text])[0], "<i4").tolist() == sp.encode(text)



def test_op8_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.com/x", link.format("http://b.net/y")), (2, "http://c.com/z#t", '<meta http-equiv="refresh" content="0;url=http://a.com/x">'), (3, "http://d.com/", ""), (4, "http://www.example.net/en/q", link.format("http://b.net/y")),
        (5, "no url", None), (6, None, None), (7, "HTTP://EXAMPLE.com/de/a?b", ""), (8, "http://e.org/fr/a", link.format("http://f.com/1")), (9, "http://f.com/1", ""), (10, "http://g.com/", link.format("http://f.net/2")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(pages).collect()}
    assert got[4] == ("www.example.net", "/en/q", "example.net/en/", "allow") and got[7] == ("example.com", "/de/a", "example.com/de/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[3][3] == "allow" and got[9][3] == "allow" and got[10][3] == "block"
    assert got[1][3] == got[2][3] == "allow"  # linked to page 4, which a rule allows
    got = {r.page_id: r.verdict for r in urls.url_filter(pages.filter("page_id <> 4")).collect()}
    assert got[1] == got[2] == "block"
    many = urls.RULES + [("block", f"h{i}.com", "/") for i in range(300)]
    assert sorted(map(tuple, urls.url_filter(pages, many).collect())) == sorted(map(tuple, urls.url_filter(pages).collect()))


def test_op8_targets_of_every_form():
    page = "http://b.com/d/e;p?q=1#f"
    refs = ["page2.html", "../a", "../../../g", "./", "..", "g/./h/../i", "?id=3", "#top", "/r?u=http://x.y/z", "//C.com/k", "HTTP://Example.com/a", "http://u:P@EX.com/A/../B?C", "/s?a=1&amp;b=2&copy=3", "/&#x41;&#66;&eacute;&#150;&#0;&nosuch;&amp", "mailto:a@b"]
    got = {t: (str(urls.Url.of(page).joined(urls.Url.of(urls._attribute(t)))), urls._attribute(t)) for t in refs}
    want = ["http://b.com/d/page2.html", "http://b.com/a", "http://b.com/g", "http://b.com/d/", "http://b.com/", "http://b.com/d/g/i", "http://b.com/d/e;p?id=3", "http://b.com/d/e;p?q=1", "http://b.com/r?u=http://x.y/z", "http://c.com/k", "http://example.com/a", "http://u:P@ex.com/B?C"]
    assert [got[t][0] for t in refs[:12]] == want
    assert got[refs[12]][1] == "/s?a=1&b=2&copy=3" and got[refs[13]][1] == "/ABé–\ufffd&nosuch;&"


def test_op8_aliases_by_relative_targets(spark):
    link, back = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    forms = [("/p/x", link, "page2.html", "/p/page2.html"), ("/q/r/x", link, "../a", "/q/a"), ("/s", link, "?id=3", "/s?id=3"), ("/t/x", back, "next.html", "/t/next.html"), ("/u", link, "/v?a=1&amp;b=2", "/v?a=1&b=2"), ("/w", link, "HTTP://I.com/W1", "/W1"), ("/y", '<base href="/z/">' + link, "c", "/z/c")]
    rows = [(2 * i, f"http://i.com{a}", how.format(to)) for i, (a, how, to, _) in enumerate(forms)]
    rows += [(2 * i + 1, f"HTTP://I.COM{b}", link.format(f"http://blocked{i}.net/")) for i, (*_, b) in enumerate(forms)]
    got = {r.page_id: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(2 * len(forms)), "block")


def test_empty_tables(none, spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (licenses.license_scan(none), language.language_id(none), decontaminate.contamination(none, items), quality.quality(none), pieces.tokenize(none), suffix_dedup.suffix_dedup(none), simhash.near_duplicates(none), extract.extract(pages), warc.derivatives(pages), urls.url_filter(pages)):
        assert df.count() == 0


def test_repeated_rows(docs, spark):
    twice = docs.filter("doc_id < 40").union(docs.filter("doc_id < 40"))
    n = twice.count()
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for df in (licenses.license_scan(twice), language.language_id(twice), decontaminate.contamination(twice, items), quality.quality(twice), pieces.tokenize(twice), suffix_dedup.suffix_dedup(twice), simhash.near_duplicates(twice)):
        assert df.count() == n


def test_repeated_rows_remove_nothing_more(docs, spark):
    once = docs.filter("doc_id < 40").dropDuplicates(["doc_id"])
    told = lambda d: {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(d).collect()}
    assert told(once.union(once).union(once)) == told(once)


def test_pipeline_stages(spark, docs, data, tmp_path):
    import corpus_pipeline as cp

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = cp.language_id(spark, own, data)
    kept = {r.doc_id for r in out.collect()}
    assert kept == {r.doc_id for r in own.collect() if any(c.isalpha() for c in r.text or "")} and out.columns == own.columns
    near = {r.doc_id for r in simhash.near_duplicates(own).filter("doc_id = component_id").collect()}
    out = cp.simhash_near_dedup(spark, own, data)
    assert {r.doc_id for r in out.collect()} == near and out.columns == own.columns
    whole = {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(own).collect()}
    out = cp.suffix_array_dedup(spark, own, data)
    assert out.columns == own.columns
    for r in out.collect():
        assert (r.text or "") == whole[r.doc_id].decode("utf-8", "ignore") and r.n_chars == len(r.text or "")
    bad = {r.doc_id for r in decontaminate.contamination(own, spark.read.parquet(f"{data}/benchmark.parquet")).filter("contaminated").collect()}
    out = cp.decontamination(spark, own, data)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in own.select("doc_id").collect()} - bad and bad
    assert cp.sentencepiece(spark, own, data).filter(~F.col("round_trip")).count() == 0
