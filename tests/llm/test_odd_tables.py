"""Tables with clashing columns, other types of ids, null ids, hot keys and very long texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, extract, language, licenses, pieces, quality, simhash, suffix_dedup, urls, warc

CLASH = "did string, k int, b string, spans int, raw_null int, row string, kept string, `_id` int, `_salt` int, `_hot` int, gone int, n int, h long, fp int, root int"


def clashing(spark, rows):
    """doc_id, text, n_chars and columns that the operators' own names clash with."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *("x", 1, "y", 2, 3, "z", "w", 4, 5, 6, 7, 8, 9, 10, 11)) for r in rows], "doc_id long, text string, n_chars int, " + CLASH)


PASSAGE = "the quick brown fox jumps over the lazy dog while the band plays on and on until the morning comes again at last"


def test_suffix_stage_keeps_columns_of_any_name(spark):
    rows = [(1, "first " + PASSAGE), (2, PASSAGE + " second"), (3, None), (4, ""), (5, PASSAGE), (None, "null id " + PASSAGE)]
    docs = clashing(spark, rows)
    got = suffix_dedup.without_repeats(docs)
    assert got.schema == docs.schema
    out = {r.doc_id: r for r in got.collect()}
    assert out.keys() == {None, 1, 2, 3, 4} and out[None].text == "null id " + PASSAGE and out[3].text is None and out[4].text == ""
    assert PASSAGE not in out[1].text and PASSAGE not in out[2].text and all(r.n_chars == len(r.text or "") and r.raw_null == 3 and r.did == "x" for r in out.values())


def test_op9_ids_of_other_types(spark):
    rows = [(f"id-{i:03}", f"{i} " + PASSAGE * (1 + i % 2)) for i in range(20)] + [(None, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    want = {}
    seen = set()
    for i, t in ranked:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        want[i] = hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest()
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.suffix_dedup(docs).collect()} == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_joins_are_the_plain_ones(spark, how, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(600)] + [(None, 1)], "a int, i int").cache()
    right = spark.createDataFrame([(a, f"v{a}") for a in range(6)], "a int, v string")
    assert common.hot_keys(left, ["a"]).count() == 7
    plain = left.join(right, ["a"], how)
    assert sorted(map(str, common.joined(left, right, ["a"], how).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_salted_give_the_same_results(spark, monkeypatch):
    common_line = "a common line that stands in very many of the documents of this table, word for word, in all of them "
    rows = [(i, ("copy " * 60 if i % 3 == 0 else f"text {i} {i * 7} " * 3) + common_line + f"tail {i % 5} " * 9) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [sorted(map(tuple, f(docs).collect())) for f in (suffix_dedup.suffix_dedup, simhash.near_duplicates)]
    for m in (common, suffix_dedup):
        monkeypatch.setattr(m, "HOT_ROWS", 10)
    assert [sorted(map(tuple, f(docs).collect())) for f in (suffix_dedup.suffix_dedup, simhash.near_duplicates)] == plain


def test_intermediate_tables_are_dropped(spark):
    path = common.saved(spark.range(10))
    files = path.inputFiles()
    common.drop(path)
    assert files and spark._jvm.java.io.File(files[0].removeprefix("file:")).exists() is False


def test_one_of_each_tells_rows_by_id_and_text(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, "other words that stand alone here"), (None, "other words that stand alone here"), (3, b), (3, None), (4, "")]
    docs = clashing(spark, rows)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in [(1, a), (1, b), (None, "other words that stand alone here"), (3, None)])


def test_decontamination_tells_rows_by_id_and_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item), (1, "clean words"), (None, item), (None, "clean"), (2, None), (3, "")]
    docs = clashing(spark, rows)
    items = spark.createDataFrame([(1, item, "x")], "item_id int, text string, h string")
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in rows if t != item)
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.clean(docs, none).count() == 6 and {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}


@pytest.mark.parametrize("hot", [256, 5])
def test_decontamination_beyond_the_broadcast(spark, monkeypatch, hot):
    """A text of 20,000 words, many texts, a passage that a third of them share."""
    r = random.Random(1)
    item = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(r.randint(3, 30)))
    items = [(i, item()) for i in range(300)]
    rows = [(i, f"intro {i} " + (items[0][1] if i % 3 == 0 else items[i % 300][1][: 5 * i % 60]) + f" outro {i % 9}") for i in range(10_000)]
    rows += [(10_000, " ".join([f"v{i}" for i in range(19_000)] + [t for _, t in items[:40]])), (10_001, items[3][1].upper()), (None, items[4][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "HOT_ROWS", hot)
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    plan = decontaminate.contamination(docs, bench)
    assert sorted(map(str, plan.collect())) == want


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 200,000 words, a megabyte without a space, each twice under two ids, and repeated rows."""
    words = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(200_000)) + " all rights reserved"
    solid = "".join(chr(0x4E00 + i * 31 % 3000) for i in range(350_000))
    rows = [(1, words, "en"), (2, words, "en"), (3, solid, "zh"), (4, solid, "zh"), (4, solid, "zh"), (5, "short one", "en")]
    return words, solid, spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).repartition(6)


def test_very_long_texts(spark, long_docs):
    words, solid, docs = long_docs
    by = lambda df: {r.doc_id: r for r in df.collect()}
    one = by(licenses.license_scan(docs))
    assert (one[1].n_words, one[1].n_base, one[1].first_word, one[3].n_words) == (200_003, 1, 200_000, 1)
    assert {i: r.lang_pred for i, r in by(language.language_id(docs)).items()}.keys() == {1, 2, 3, 4, 5}
    items = spark.createDataFrame([(1, " ".join(words.split()[150_000:150_020])), (2, solid), (3, "nothing here")], "item_id long, text string")
    three = by(decontaminate.contamination(docs, items))
    assert (three[1].n_words, three[1].n_hit, three[1].contaminated) == (200_003, 20, False) and (three[3].n_words, three[3].n_hit, three[3].contaminated, three[3].n_items) == (1, 1, True, 1)
    five = by(quality.quality(docs))
    assert five[1].n_words == 200_003 and five[3].word_chars == 350_000 and five[3].base_failed
    w, seen = words.split(), {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    assert five[1].n_repeat_words == len({p + j for v in seen.values() if len(v) > 1 for p in v for j in range(3)})
    assert all(r.round_trip for r in pieces.tokenize(docs, with_ids=False).collect())
    nine = by(suffix_dedup.suffix_dedup(docs))
    assert nine[1].n_removed < nine[1].n_bytes // 2 and nine[2].n_removed == nine[2].n_bytes == len(words) and nine[4].n_removed == nine[4].n_bytes == 3 * 350_000
    assert {i: r.component_id for i, r in by(simhash.near_duplicates(docs)).items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_very_long_and_repeated_pages(spark, long_docs):
    words, solid, _ = long_docs
    html = f'<html><body><nav><a href="/">home</a></nav><article><p>{words}</p><p>{solid}</p></article><footer>end</footer><link rel="canonical" href="http://b.net/x"></body></html>'
    pages = spark.createDataFrame([(1, "http://a.com/" + "p" * 300_000, html), (1, "http://a.com/" + "p" * 300_000, html), (2, "http://c.com/", "")], "page_id long, url string, html string")
    four = [(r.page_id, r.n_chars) for r in extract.extract(pages).collect()]
    assert sorted(four) == [(1, len(words) + 1 + len(solid))] * 2 + [(2, 0)]
    eight = sorted((r.page_id, r.verdict) for r in urls.url_filter(pages).collect())
    assert eight == [(1, "block"), (1, "block"), (2, "allow")]
    seven = warc.derivatives(pages)
    assert seven.count() == 3 and seven.select("conversion_id").distinct().count() == 2


def test_ties_between_languages():
    m = language.Model({"b": "same text here", "a": "same text here", "c": "same text here"})
    assert m.predict(["text here", ""]) == (["a", "und"], [0.0, 0.0])
