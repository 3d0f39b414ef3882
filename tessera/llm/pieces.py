"""SentencePiece encoding and decoding with a shared-prefix forward pass.

Distinct marked words of a batch are sorted, which lays out their trie depth first; the forward pass keeps, for each
prefix on the current path, its best score, the piece that ends its segmentation and where that piece starts, and a
word resumes at the prefix that it shares with the one before. The ids are read off once, from the word's end, so a
word takes room in proportion to its length, however long it is (a text without spaces is one word).

The model's own kind decides what is best. Unigram: the sum of the pieces' scores, in double precision; of equal sums
the longer last piece. Merges: a segmentation is the model's own if each two neighbouring pieces stay apart when their
joint string is merged by itself, so the piece that ends a prefix is the one that stays apart from the piece that ends
the rest, as the best sum would be another segmentation. Other kinds, and models that normalise texts, are refused.
Characters without a piece become bytes.

Null texts have no ids; empty texts have none either. Decoding gives the text back exactly, but that U+2581 becomes a
space, as the model has it. Repeated rows are each encoded; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, table

MARK = "▁"
#: Words whose ids a worker keeps between batches, and the length from which a word isn't kept.
MEMORY, KEPT = 200_000, 64
#: Pairs of pieces whose answer it keeps. Of both, half is what was met of late; as it is full, it takes the place of the
#: other half, out of which what is met again comes back, so frequent words and pairs are worked out once.
PAIRS = 600_000


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    return k


def default_model() -> str:
    """The file that PIECE_MODEL names, else the one of the module public_tokenizers where that is installed."""
    if p := os.environ.get("PIECE_MODEL"):
        return p
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


UNIGRAM, MERGES = 1, 2


def kind_of(model: bytes) -> int:
    """UNIGRAM or MERGES, from the model's trainer settings; its normaliser must leave texts as they are."""
    parts = dict(_fields(model))
    trainer, normal = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, MERGES):
        raise ValueError(f"models of kind {kind} have no segmentation by pieces")
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("the model normalises texts, so ids wouldn't give them back")
    return kind


class Pieces:
    """Vocabulary and scores of a piece model with byte fallback; the library only reads the file."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.kind = kind_of(model)
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_at = next(i for i in range(n) if sp.is_byte(i))
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        names = sp.id_to_piece(normal)
        self.ids = dict(zip(names, normal, strict=True))
        scores = sp.get_score(normal)
        self.rank = {p: (-s, i) for p, s, i in zip(names, scores, normal, strict=True)}
        self.score = dict(zip(names, scores, strict=True))
        self.unknown = min(scores) - 10.0  # the library's penalty
        self.raw = [bytes([i - self.bytes_at]) if self.bytes_at <= i < self.bytes_at + 256 else b"" for i in range(n)]
        for p, i in self.ids.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        ends: dict[str, set[int]] = {}
        for p in names:
            ends.setdefault(p[-3:], set()).add(len(p))
        self.sizes = {e: tuple(sorted({*x, 1, *(() if len(e) < 3 else (2,))}, reverse=True)) for e, x in ends.items()}
        assert n <= 1 << 16 and 0 not in self.ids.values()
        self.names = {i: p for p, i in self.ids.items()}
        self.packs = [i.to_bytes(4, "little") for i in range(n)]
        self.apart: dict[int, bool] = {}
        self.apart_before: dict[int, bool] = {}
        inner = [p for p in names if MARK in p.lstrip(MARK)]
        assert not inner, "pieces that cross words need whole texts as words"
        self.split = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if "\n" not in self.ids and not any("\n" in p for p in names) else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.memory: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges of a short string, one by one: the best-ranked pair first, the leftmost of equals."""
        out = list(text)
        while len(out) > 1:
            best = min(((self.rank.get(out[i] + out[i + 1], (float("inf"), 0)), i) for i in range(len(out) - 1)), default=None)
            if best is None or best[0][0] == float("inf"):
                break
            i = best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def stays_apart(self, key: int) -> bool:
        """Whether two neighbouring pieces, given as first << 16 | second (first 0: none), are merged no further."""
        x, y = self.names.get(key >> 16, ""), self.names[key & 0xFFFF]
        if len(self.apart) >= PAIRS // 2:
            # in place, as a pass holds the dictionary
            self.apart_before = dict(self.apart)
            self.apart.clear()
        got = self.apart_before.get(key)
        if got is None:
            got = self.merged(x + y) == ([x, y] if x else [y])
        self.apart[key] = got
        return got

    def packed(self, words: Iterable[str]) -> dict[str, bytes]:
        """Little-endian ids of distinct words, by one depth-first pass over their trie."""
        return (self._by_scores if self.kind == UNIGRAM else self._by_merges)(sorted(words))

    def _ids(self, word: str, tail: list[int], back: list[int]) -> bytes:
        """The ids of a word from the piece that ends each prefix (0: bytes) and the place where it starts."""
        out, end, packs = [], len(word), self.packs
        while end:
            a = back[end]
            out.append(packs[tail[end]] if tail[end] else b"".join((self.bytes_at + x).to_bytes(4, "little") for x in word[a:end].encode("utf-8", "surrogatepass")))
            end = a
        out.reverse()
        return b"".join(out)

    def _by_merges(self, words: list[str]) -> dict[str, bytes]:
        find, sizes, apart, stays = self.ids.get, self.sizes.get, self.apart.get, self.stays_apart
        out: dict[str, bytes] = {}
        before, tail, back = "", [0], [0]
        for w in words:
            k = _shared(w, before)
            del tail[k + 1 :], back[k + 1 :]
            for end in range(k + 1, len(w) + 1):
                for size in sizes(w[end - 3 if end > 3 else 0 : end], (2, 1)):
                    if (a := end - size) < 0:
                        continue
                    piece = find(w[a:end])
                    if piece is None:
                        if size > 1:
                            continue
                        # no piece: bytes, and what follows begins anew
                        tail.append(0)
                        back.append(a)
                        break
                    ok = apart(key := tail[a] << 16 | piece)
                    if ok or ok is None and stays(key):
                        tail.append(piece)
                        back.append(a)
                        break
                else:
                    raise AssertionError(f"no segmentation of {w[:end]!r}")
            out[w] = self._ids(w, tail, back)
            before = w
        return out

    def _by_scores(self, words: list[str]) -> dict[str, bytes]:
        find, sizes, score = self.ids.get, self.sizes.get, self.score
        out: dict[str, bytes] = {}
        before, best, tail, back = "", [0.0], [0], [0]
        for w in words:
            k = _shared(w, before)
            del best[k + 1 :], tail[k + 1 :], back[k + 1 :]
            for end in range(k + 1, len(w) + 1):
                top, piece, start = float("-inf"), 0, end - 1
                for size in sizes(w[end - 3 if end > 3 else 0 : end], (2, 1)):  # longest first
                    if (a := end - size) < 0:
                        continue
                    if (p := find(w[a:end])) is not None:
                        s = best[a] + score[w[a:end]]
                    elif size == 1:
                        p, s = 0, best[a] + self.unknown
                    else:
                        continue
                    if s > top:
                        top, piece, start = s, p, a
                best.append(top)
                tail.append(piece)
                back.append(start)
            out[w] = self._ids(w, tail, back)
            before = w
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.split((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        words = {w for ws in split for w in ws}
        if len(self.memory) > MEMORY // 2:
            self.memory, self.before = {}, self.memory
        found, before = self.memory, self.before
        again = (words - found.keys()) & before.keys()
        found.update(zip(again, map(before.__getitem__, again), strict=True))
        new = words - found.keys()
        found.update(self.packed(new))
        ids = [b"".join(map(found.__getitem__, ws)) for ws in split]
        for w in new:
            if len(w) > KEPT:
                del found[w]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_OPEN: dict[str, Pieces] = {}


def opened(path: str, shared: Broadcast | None = None) -> Pieces:
    """The model of a path, opened once in a process; workers get the file's bytes from the driver."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(shared.value if shared else Path(path).read_bytes())
    return _OPEN[path]


def _shipped(df: DataFrame, path: str) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _digest(path: str, shared: Broadcast, with_ids: bool):
    def rows(batch: pa.RecordBatch) -> dict:
        p, texts = opened(path, shared), batch.column(1).to_pylist()
        out = []
        for a, b in byte_slices([len(t or "") for t in texts], 1 << 20):
            for t, ids in zip(texts[a:b], p.encode(texts[a:b]), strict=True):
                v = np.frombuffer(ids, "<i4")
                out.append((len(v), hashlib.sha256(ids).hexdigest(), p.decode(v) == (t or "").replace(MARK, " "), v if with_ids else None))
        cols = dict(zip(("n_tokens", "ids_sha256", "round_trip", "ids"), zip(*out, strict=True), strict=True))
        return {"doc_id": batch.column(0)} | cols

    return rows


def tokenize(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), round_trip, and the ids."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    path = path or default_model()
    return map_arrow(docs.select("doc_id", "text"), _digest(path, _shipped(docs, path), with_ids), schema)


def _texts(path: str, shared: Broadcast):
    def rows(batch: pa.RecordBatch) -> dict:
        p = opened(path, shared)
        return {"doc_id": batch.column(0), "text": [None if x is None else p.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]}

    return rows


def detokenize(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text."""
    path = path or default_model()
    return map_arrow(tokens.select("doc_id", F.col("ids")), _texts(path, _shipped(tokens, path)), f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), with_ids=False)
