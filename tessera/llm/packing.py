"""Best-fit packing of token sequences under several capacities at once.

A piece is a vector of its tokens, one document and its attention cost (the square of its tokens); a bin has a capacity
of each. All three follow from the piece's length, so the plan needs no more than how many pieces there are of each
length, at most one number for each length up to a bin's: lengths are planned, not rows, and whole classes of bins that
are filled alike at once. Two rules make plans, longest lengths first:

* norm: a piece goes where the weighted norm of what is left is least (best fit). As a bin that has just become the
  fullest stays the best for the next piece of that length, one step fills a whole class of bins.
* dot: a bin takes the length of the largest weighted dot product with what is left in it, until none fits, and is
  repeated as long as there are enough pieces of its lengths.

The plan of fewer bins is carried out: pieces are put in order by length and id, in ranges that are sorted side by side,
and each run of places has its bins, so no task ever holds a length's pieces or a bin's candidates.

Null and empty texts are one token long, the end. Texts may be of any length: longer ones than a bin are cut, and only
those. Repeated rows are packed each for itself, null ids too. Empty tables give empty tables. Extra columns are ignored
by tokenized() and kept by pack().
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import placed
from .common import byte_slices, map_arrow, saved, table
from .words import LOWER, SPACED, split

#: Tokens of a bin, the id that ends each document, parts of texts after which a worker keeps no more ids, the length from which a part isn't kept.
LENGTH, END, MEMORY, KEPT = 4096, 1, 300_000, 64


def default_tokenizer() -> str:
    """The file that WORD_TOKENIZER names, else the one of the module public_tokenizers where that is installed."""
    if p := os.environ.get("WORD_TOKENIZER"):
        return p
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the encoder relies on to take texts apart (fixed values): how the tokenizer normalises texts, and its tokens' pattern.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_LETTER, _DIGIT, _OTHER, _LOOSE = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*range(48, 58)]] = _DIGIT
_KIND[[39, *range(128, 256)]] = _LOOSE  # apostrophes and what isn't ASCII may belong to either side


def _breaks(data: np.ndarray) -> np.ndarray:
    """Where a part ends whatever stands around it: between a letter, a digit and other ASCII, and after each digit."""
    k = _KIND[data]
    return ((k[1:] != k[:-1]) | (k[1:] == _DIGIT)) & (k[1:] != _LOOSE) & (k[:-1] != _LOOSE)


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case where no combining character may follow."""
    low = LOWER[data]
    return np.where(np.append(data[1:] < 128, True), low, data)


class Encoder:
    """Ids of a tokenizer; of one that NORMAL and PATTERN describe each distinct part of a batch's texts is encoded once."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(model)
        told = json.loads(model)
        first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_parts = (told.get("normalizer") or {}).get("normalizers") == NORMAL and first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        self.special = [t["content"] for t in told.get("added_tokens") or []]
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _parts(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each part with its ids. Parts that no normalisation lengthens or joins are encoded many at a time, told apart by where tokens start."""
        plain, other = [], []
        for p in parts:
            t = p.decode()
            (plain if len(t) < KEPT and (t.isascii() or (max(t) < "\u0180" and "\u0130" not in t)) else other).append(t)
        yield from zip((t.encode() for t in other), self._encode(other), strict=True)
        for at in range(0, len(plain), 4096):
            groups = [plain[i : i + 64] for i in range(at, min(at + 4096, len(plain)), 64)]
            for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids, begin = np.array(e.ids, "<u4"), np.fromiter((a for a, _ in e.offsets), np.int64)
                ends = np.cumsum([len(t) + 1 for t in group])
                cuts = [0, *np.searchsorted(begin, ends).tolist()]
                yield from ((t.encode(), ids[a:b].tobytes()) for t, a, b in zip(group, cuts, cuts[1:], strict=False))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's end, from 0 on."""
        if not self.by_parts or any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.special):
            raw = self._encode([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(raw), "<u4"), np.append(0, np.cumsum([len(x) // 4 for x in raw], dtype=np.int64))
        w = split(texts, SPACED, _folded, _breaks)
        distinct = w.distinct.to_pylist()
        fresh = dict(self._parts([x for x in distinct if x not in self.known]))
        ids = [fresh[x] if x in fresh else self.known[x] for x in distinct]
        if len(self.known) < MEMORY:
            self.known.update((x, i) for x, i in fresh.items() if len(x) < KEPT)
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        each, starts = sizes[w.codes], np.append(0, np.cumsum(sizes))[:-1]
        before = np.append(0, np.cumsum(each))
        return flat[np.repeat(starts[w.codes] - before[:-1], each) + np.arange(before[-1])], before[w.ends]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: str) -> Encoder:
    key = zlib.crc32(model.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def tokenized(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian, 32 bits each) of every piece of every document."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the tokenizer's file

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = [0 if x is None else x for x in batch["size"].to_pylist()]
        for a, b in byte_slices(sizes, 4 << 20):
            yield batch.slice(a, b - a)

    def rows(batch: pa.RecordBatch) -> dict | None:
        encoder, out = _encoder(model.value), {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
        for at, part in _counted(slices(batch)):
            ids, ends = encoder.texts(part["text"])
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                for n, s in enumerate(range(0, len(own), length)):
                    raw = own[s : s + length].tobytes()
                    out["at"].append(at + i)
                    out["piece"].append(n)
                    out["start"].append(s)
                    out["length"].append(len(raw) // 4)
                    out["ids_crc32"].append(zlib.crc32(raw))
                    if with_ids:
                        out["ids"].append(raw)
        out["doc_id"] = batch["doc_id"].take(pa.array(out.pop("at"), pa.int64()))
        return out

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_arrow(docs.select("doc_id", "text", F.octet_length("text").alias("size")), rows, schema, lambda: _ENCODERS.clear())


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    n = 0
    for p in parts:
        yield n, p
        n += p.num_rows


class Capacity(NamedTuple):
    """What a bin holds at most, and how much each of the three counts."""

    tokens: int = LENGTH
    documents: int = LENGTH
    cost: int = LENGTH * LENGTH
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def whole(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], np.int64)

    def share(self) -> np.ndarray:
        return np.array(self.weights) / np.maximum(self.whole(), 1) ** 2


def _vector(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


#: A class of bins filled alike: how many, and (length, pieces of it) in the order they stand in.
Plan = list[tuple[int, list[tuple[int, int]]]]


def by_norm(counts: dict[int, int], capacity: Capacity) -> Plan:
    """Best fit, longest first, over classes of bins that are filled alike."""
    whole, share = capacity.whole(), capacity.share()
    room, many, held = np.empty((64, 3), np.int64), np.zeros(64, np.int64), []

    def add(left: np.ndarray, bins: int, pieces: list[tuple[int, int]]) -> None:
        nonlocal room, many
        if len(held) == len(many):
            room, many = (np.concatenate([x, np.zeros_like(x)]) for x in (room, many))
        room[len(held)], many[len(held)] = left, bins
        held.append(pieces)

    for length in sorted(counts, reverse=True):
        piece, left = _vector(length), counts[length]
        most = lambda r: int((r // piece).min())  # noqa: B023, E731
        while left:
            at = len(held)
            fits = np.flatnonzero((many[:at] > 0) & (room[:at] >= piece).all(1))
            if len(fits):
                after = (share * (room[fits] - piece).astype(float) ** 2).sum(1)
                c = int(fits[after.argmin()])
                base, bins, pieces = room[c].copy(), int(many[c]), held[c]
                many[c] = 0
            else:
                base, pieces = whole, []
                bins = -(-left // most(whole))
            each = most(base)
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            if full:
                add(base - each * piece, full, [*pieces, (length, each)])
            if rest:
                add(base - rest * piece, 1, [*pieces, (length, rest)])
            if (same := bins - full - (rest > 0)) > 0:
                add(base, same, pieces)
            left -= full * each + rest
    return [(int(many[i]), held[i]) for i in range(len(held)) if many[i]]


def by_dot(counts: dict[int, int], capacity: Capacity) -> Plan:
    """Bins one kind after the other: the length of the largest weighted dot product with what is left goes in next."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], np.int64)
    vectors = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1)
    share, plan = capacity.share(), []
    while left.any():
        room, free, pieces = capacity.whole(), left.copy(), []
        while True:
            fits = np.flatnonzero((free > 0) & (vectors <= room).all(1))
            if not len(fits):
                break
            c = int(fits[(vectors[fits] * (share * room)).sum(1).argmax()])
            each = 1 if (share[1:] > 0).any() else min(int((room // vectors[c]).min()), int(free[c]))
            room, free[c] = room - each * vectors[c], free[c] - each
            if pieces and pieces[-1][0] == c:
                pieces[-1] = (c, pieces[-1][1] + each)
            else:
                pieces.append((c, each))
        need = Counter()
        for c, n in pieces:
            need[c] += n
        bins = min(int(left[c]) // n for c, n in need.items())
        for c, n in need.items():
            left[c] -= bins * n
        plan.append((bins, [(int(lengths[c]), n) for c, n in pieces]))
    return plan


def planned(counts: dict[int, int], capacity: Capacity = Capacity(), rule: str | None = None) -> Plan:
    """The plan of the given rule, or of the one that needs fewer bins."""
    over = [n for n in counts if (_vector(n) > capacity.whole()).any()]
    if over:
        raise ValueError(f"pieces of {max(over)} tokens are over a bin's capacity")
    plans = [f(counts, capacity) for f in ({"norm": by_norm, "dot": by_dot}[rule],)] if rule else [by_norm(counts, capacity), by_dot(counts, capacity)]
    return min(plans, key=lambda p: sum(n for n, _ in p))


def _runs(plan: Plan, counts: dict[int, int]) -> np.ndarray:
    """Rows (first place, pieces a bin, first bin, offset in it, length): what the places of pieces, ordered by length, have for bins."""
    starts, at = {}, 0
    for n in sorted(counts):
        starts[n] = at
        at += counts[n]
    rows, bin_ = [], 0
    for bins, pieces in plan:
        offset = 0
        for length, each in pieces:
            rows.append((starts[length], each, bin_, offset, length))
            starts[length] += bins * each
            offset += length * each
        bin_ += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), rule: str | None = None) -> DataFrame:
    """pieces (a table that is kept; doc_id, piece, length and any other columns), each with sequence_id and offset, its place there without gaps."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many rows as lengths
    runs = pieces.sparkSession.sparkContext.broadcast(_runs(planned(counts, capacity, rule), counts))
    ordered = placed(pieces.select(F.struct(*pieces.columns).alias("row")), "row.length", "row.doc_id", "row.piece", name="place")

    def rows(places: pa.Array) -> pa.Array:
        place, table = places.to_numpy(), runs.value
        r = table[np.searchsorted(table[:, 0], place, "right") - 1].reshape(-1, 5)
        nth = place - r[:, 0]
        return pa.StructArray.from_arrays([pa.array(r[:, 2] + nth // r[:, 1]), pa.array(r[:, 3] + nth % r[:, 1] * r[:, 4])], ["sequence_id", "offset"])

    spot = F.arrow_udf(rows, "struct<sequence_id:bigint,offset:bigint>")(F.col("place"))
    return ordered.select("row", spot.alias("spot")).select("row.*", "spot.*")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (all tokens, little-endian, 32 bits each) and documents (doc_id, piece, offset, length) of every bin; packed has ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))  # a bin's capacity at most
    joined = F.aggregate("_in", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    told = F.transform("_in", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return packed.groupBy("sequence_id").agg(inside.alias("_in")).select("sequence_id", joined.alias("ids"), told.alias("documents"))


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(saved(tokenized(table(spark, sf_dir, "documents"), with_ids=False)))
