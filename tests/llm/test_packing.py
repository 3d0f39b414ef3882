"""Packing: ids against the library, plans against best fit of single pieces, every capacity kept, odd tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.packing import Capacity
from tessera.llm.queries import QUERIES


def bins_of(plan):
    """Every bin of a plan as its list of lengths."""
    return [[n for n, k in pieces for _ in range(k)] for bins, pieces in plan for _ in range(bins)]


def single_best_fit(lengths, capacity):
    """Piece by piece, the longest first: the bin with the least norm left, else a new one."""
    share, bins = capacity.share(), []
    for n in sorted(lengths, reverse=True):
        v = np.array([n, 1, n * n])
        fits = [i for i, r in enumerate(bins) if (r >= v).all()]
        if fits:
            i = min(fits, key=lambda i: (share * (bins[i] - v).astype(float) ** 2).sum())
            bins[i] = bins[i] - v
        else:
            bins.append(capacity.whole() - v)
    return len(bins)


CAPACITIES = [Capacity(100, 100, 10_000), Capacity(100, 3, 10_000, (1.0, 1.0, 0.0)), Capacity(100, 8, 5_100, (1.0, 0.5, 1.0)), Capacity(64, 64, 4096, (0.0, 0.0, 1.0))]


@pytest.mark.parametrize("capacity", CAPACITIES)
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plans_keep_every_capacity_and_piece(capacity, rule):
    for seed in range(12):
        r = random.Random(seed)
        lengths = [min(capacity.tokens, int((capacity.cost) ** 0.5), r.choice((1, 2, r.randint(1, 20), r.randint(1, capacity.tokens)))) for _ in range(r.choice((1, 7, 60, 300)))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.planned(counts, capacity, rule)
        bins = bins_of(plan)
        assert sorted(n for b in bins for n in b) == sorted(lengths)
        assert all(sum(b) <= capacity.tokens and len(b) <= capacity.documents and sum(n * n for n in b) <= capacity.cost for b in bins)
        single = single_best_fit(lengths, capacity)
        if rule == "norm":
            assert abs(len(bins) - single) <= max(1, single // 20)
        assert len(bins) <= single * 1.3 + 1


def test_plans_of_edges():
    assert packing.planned({}) == []
    assert [n for n, _ in packing.planned({4096: 5_000_000_000})] == [5_000_000_000]
    assert sum(n for n, _ in packing.planned({1: 4096 * 10 + 1})) == 11
    assert sum(n for n, _ in packing.planned({2049: 7, 2047: 7, 4000: 2, 96: 2})) == 9
    with pytest.raises(ValueError):
        packing.planned({200: 1}, Capacity(100, 100, 10_000))
    with pytest.raises(ValueError):
        packing.planned({90: 1}, Capacity(100, 100, 8_000))


TEXTS = ["Don't stop 123 ÀÉ́  x y", "", None, "a\tb\n\nc\x0bd\x1ce\r\nf", "日本語テスト Ωσς ΑΣ", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "the cat sat " * 3000, "z" * 30_000, "e ́ q", "we've 'll 's", "퟿\U0001f600 ok"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(r.choice(("lorem", "ipsum", "dolor,", "sit.", "x1")) for _ in range(r.randrange(900)))) for i in range(150)] + [(None, "null id"), (3, "same id"), (3, "same id")]
    return rows, spark.createDataFrame([(*x, "a", 1, 2) for x in rows], "doc_id long, text string, row string, place int, length int").repartition(5)


def test_ids_of_any_text():
    """Parts of all kinds of characters, next to each other in every order, against the library on whole texts."""
    import pyarrow as pa

    e, t = packing.Encoder(open(packing.default_tokenizer()).read()), Tokenizer.from_file(packing.default_tokenizer())
    assert e.by_parts
    r = random.Random(8)
    alphabet = [*"aZz09.,!'\"<|>-_ ", "'S", "'ll", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "é", "É", "\u0301", "\u0331", "H", "h", "I", "\u0130", "\u0307", "ß", "ſ", "K", "Σ", "σ", "中", "…", "—", "½", "२", "\u0958", "ﬁ", "\u200d", "👩", "\u1100\u1161", "\0", "\u0345", "ǆ", "İ", "‘", "\u2028"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 12))) for _ in range(20_000)] + [None, "", " ", "word " * 9]
    for a in (0, 10_000, 20_000):
        part = texts[a : a + 10_000]
        ids, ends = e.texts(pa.array(part))
        want = [x.ids for x in t.encode_batch([x or "" for x in part], add_special_tokens=False)]
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == want
    t.pre_tokenizer = None
    other = packing.Encoder(t.to_str())
    assert not other.by_parts and other.texts(pa.array(["a b", None]))[0].tolist() == t.encode("a b", add_special_tokens=False).ids


def test_pieces_are_the_librarys_ids(docs):
    rows, df = docs
    t = Tokenizer.from_file(packing.default_tokenizer())
    got = sorted(str((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, bytes(x.ids))) for x in packing.tokenized(df, length=500).collect())
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for n, s in enumerate(range(0, len(ids), 500)):
            raw = ids[s : s + 500].tobytes()
            want.append(str((i, n, s, len(raw) // 4, zlib.crc32(raw), raw)))
    assert got == sorted(want)


@pytest.mark.parametrize("capacity", [Capacity(500, 500, 250_000), Capacity(500, 4, 250_000, (1.0, 1.0, 0.0))])
def test_bins_are_filled_without_gaps(spark, docs, capacity):
    from tessera.llm.common import saved

    pieces = saved(packing.tokenized(docs[1], length=500))
    packed = packing.pack(pieces, capacity)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and packed.select(pieces.columns).exceptAll(pieces).count() == 0 and packed.count() == pieces.count()
    bins = defaultdict(list)
    for x in packed.collect():
        bins[x.sequence_id].append((x.offset, x.length, bytes(x.ids)))
    for b in bins.values():
        b.sort()
        assert [o for o, _, _ in b] == [sum(n for _, n, _ in b[:i]) for i in range(len(b))] and sum(n for _, n, _ in b) <= capacity.tokens and len(b) <= capacity.documents
    least = max(-(-pieces.groupBy().sum("length").first()[0] // capacity.tokens), -(-pieces.count() // capacity.documents))
    assert len(bins) <= least * 1.05 + 1
    whole = {x.sequence_id: bytes(x.ids) for x in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(raw for _, _, raw in b) for k, b in bins.items()}


def test_query_and_empty_table(spark, data, tmp_path):
    got = QUERIES["op12_best_fit_packing"](spark, data)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    per = defaultdict(list)
    for x in rows:
        per[x.sequence_id].append((x.offset, x.length))
    assert all(b[0][0] == 0 and all(p[0] + p[1] == q[0] for p, q in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 4096 for b in map(sorted, per.values()))
    assert len(per) == -(-sum(x.length for x in rows) // 4096)
    assert all(x.length == 4096 for x in rows if (x.doc_id, x.piece + 1) in {(y.doc_id, y.piece) for y in rows})
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenized(none)).count() == 0
