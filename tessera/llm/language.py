"""Language by cross-parsing entropy.

A suffix automaton of each language's labelled text gives the longest matches; a text is parsed greedily into the
longest phrases that occur in that language's text, and the language with the fewest phrases, each weighed by the
bits that name a place in its text, wins. The automata are tables, so a batch's texts are parsed side by side. Every
letter of the samples is a symbol of its own, however many there are.

The model is fitted on a bounded sample of every labelled language: DOCS labelled texts and MODEL letters of each
(MODEL_TOTAL of all together, but MODEL_LEAST of each), ordered by hashes of doc_id and text. Of rows that share
doc_id and label the sample holds one, the smallest beginning of their texts; rows that repeat take places in the
sample. Prediction reads whole texts; a phrase ends at the borders of BLOCK symbols. Letters are compared in lower case
and runs of other characters count as one gap. Null texts and texts without letters are `und`, as are all texts if
nothing is labelled. Ties go to the first language by name. Repeated rows are each judged; texts may be of any length;
extra columns are ignored, or kept by the stage that keeps rows.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW, BROADCAST_IDENTITIES, arrow_types, byte_slices, cut, importable, map_arrow, table, trimmed

DOCS, MODEL, BLOCK = 64, 16_384, 4096
#: Letters of all languages together, so that the tables of many languages stay as small, and letters that each has even
#: of very many; every language is learned.
MODEL_TOTAL, MODEL_LEAST = 1 << 18, 128
#: Columns of the dense tables: gaps, the most frequent letters, and last the letters that no sample has. The other
#: letters have symbols from _WIDTH on, whose transitions are looked up among sorted keys.
_WIDTH = 64
_FLAG = 1 << 30


class SuffixAutomaton:
    def __init__(self, symbols: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Model:
    """Tables of all languages: entry (state, symbol) is the next state, flagged where a phrase ends. A symbol
    that the language lacks belongs to the phrase that it ends."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        count = Counter(c for t in texts.values() for c in t.lower() if c.isalpha() and len(c.lower()) == 1)
        known = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        kind = np.uint8 if len(known) + 2 <= 256 else np.int32
        self.classes = np.where(letters, kind(_WIDTH - 1), kind(0))
        for i, c in enumerate(known, 1):
            i += i >= _WIDTH - 1
            self.classes[ord(c)] = i
            if len(c.upper()) == 1 and c.upper().lower() == c:
                self.classes[ord(c.upper())] = i
        tables, self.roots, self.bits, base, keys, nexts = [], [], [], 0, [], []
        for lang in self.langs:
            symbols = self.symbols([texts[lang]])[0]
            auto = SuffixAutomaton(symbols.tolist())
            t = np.empty((len(auto.next), _WIDTH), np.int32)
            restart = np.array([auto.next[0].get(c, 0) for c in range(_WIDTH)]) + base | _FLAG
            t[:] = restart
            for s, to in enumerate(auto.next):
                for c, v in to.items():
                    if c < _WIDTH:
                        t[s, c] = v + base
                    else:
                        keys.append((s + base) << 20 | c)
                        nexts.append(v + base)
            tables.append(t)
            self.roots.append(base)
            self.bits.append(float(np.log2(max(2, len(symbols)))))
            base += len(t)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.nexts = np.array(keys, np.int64)[order], np.array(nexts, np.int32)[order]

    def found(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The transitions by sorted key, -1 where there is none."""
        key = state.astype(np.int64) << 20 | symbols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nexts[at], -1)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, flagged where a phrase ends, whatever the symbols."""
        v = self.table[(state << 6) + np.minimum(symbols, _WIDTH - 1)]
        at = np.flatnonzero(symbols >= _WIDTH)
        if len(at):
            roots = np.array(self.roots, np.int32)[:, None]
            on, again = self.found(state[:, at], symbols[at]), self.found(roots, symbols[at])
            v[:, at] = np.where(on >= 0, on, np.where(again >= 0, again, roots) | _FLAG)
        return v

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the letters, each run of other characters as one 0, and the texts' new lengths."""
        raw = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        keep = raw > 0
        gap = ~keep[1:] & keep[:-1]
        first = (ends - sizes)[(sizes > 0) & (ends - sizes > 0)]
        gap[first - 1] = False
        keep[1:] |= gap
        total = np.concatenate(([0], np.cumsum(keep)))
        return raw[keep], total[ends] - total[ends - sizes]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text under each language, and the texts' symbols."""
        flat, sizes = self.symbols(texts)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        size = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(size), 1)
        roots = state.copy()
        count = np.zeros_like(state)
        wide = bool(len(flat)) and int(flat.max()) >= _WIDTH
        alive = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), "right")
        for step, m in enumerate(alive.tolist()):
            c = flat[start[:m] + step]
            v = self.step(state[:, :m], c) if wide else self.table[(state[:, :m] << 6) + c]
            count[:, :m] += v >> 30
            state[:, :m] = v & (_FLAG - 1)
        count += state != roots
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, count[k], len(texts))
        return out, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        got, sizes = self.phrases(texts)
        rate = got * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = rate.argmin(1)
        least = rate.min(1)
        rest = rate.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(1) if len(self.langs) > 1 else least * 2
        score = np.where(sizes > 0, 1 - least / np.maximum(second, 1e-12), 0.0)
        return [self.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)], np.clip(score, 0, 1).tolist()


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


@lru_cache(maxsize=1)
def built(texts: tuple[tuple[str, str], ...]) -> Model:
    """A worker builds the tables from the sample once; the sample, not the tables, goes out with the tasks."""
    return Model(dict(texts))


def fit(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """Each language's sample, from labelled documents that are not held out."""
    taught = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = taught.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("rows"))
    known = counts.count()
    if not known:
        return ()
    most = max(MODEL_LEAST, MODEL_TOTAL // max(known, MODEL_TOTAL // MODEL))
    rows = taught.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.xxhash64("doc_id", "text").alias("o"))
    places = Window.partitionBy("lang").orderBy("o", "doc_id")
    top = rows.withColumn("n", F.row_number().over(places)).filter(F.col("n") <= DOCS)
    top = cut(top.groupBy("lang", "doc_id").agg(F.min("n").alias("n")))  # DOCS rows of each language at most
    top = F.broadcast(top) if DOCS * known <= BROADCAST_IDENTITIES else top
    begin = F.substring(F.coalesce("text", F.lit("")), 1, most)
    sample = taught.select(F.col("lang").cast("string").alias("lang"), "doc_id", begin.alias("t")).join(top, ["lang", "doc_id"]).groupBy("lang", "n").agg(F.min("t").alias("t"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], []).append((r["n"], r["t"]))
    out = {}
    for lang, held in texts.items():
        mine = [t for _, t in sorted(held)]
        share = max(1, most // max(1, sum(bool(t) for t in mine)))
        got = " ".join(t[: 4 * share] for t in mine)[:most]
        if any(c.isalpha() for c in got):
            out[lang] = got
    return tuple(sorted(out.items()))


def _predict(texts_of: tuple[tuple[str, str], ...]):
    def rows(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        lang, score = [], []
        for a, b in byte_slices([len(t) for t in texts], 4 << 20):
            x, y = built(texts_of).predict(texts[a:b])
            lang += x
            score += y
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": lang, "score": score}

    return rows


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text", held_out().alias("held_out")), _predict(fit(docs)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _accepted(texts_of: tuple[tuple[str, str], ...], column: int, lang: int, types: list[pa.DataType]):
    def run(batches):
        for batch in batches:
            texts, said = [t or "" for t in batch.column(column).to_pylist()], batch.column(lang).to_pylist()
            for a, b in byte_slices([len(t) for t in texts], 4 << 20):
                model = built(texts_of)
                if model.langs:
                    got = model.predict(texts[a:b])[0]
                else:
                    got = ["und" if not n else None for n in model.symbols(texts[a:b])[1]]
                part = batch.slice(a, b - a)
                filled = pa.array([x if x is not None else y for x, y in zip(said[a:b], got, strict=True)], types[lang])
                part = pa.RecordBatch.from_arrays([filled if i == lang else c for i, c in enumerate(part.columns)], part.schema.names)
                yield part.filter(pa.array([x != "und" for x in got]))

    return run


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are in some language, with the language that was found where lang is null.

    Rejected is what is `und`: a null text, one without a letter, and nothing else. A label that is there stays. Where
    nothing is labelled nothing can be found, and texts with a letter stay with a null lang.
    """
    importable(docs.sparkSession)
    for k, v in ARROW.items():
        docs.sparkSession.conf.set(k, v)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    run = _accepted(fit(docs), docs.columns.index("text"), docs.columns.index("lang"), arrow_types(docs.sparkSession, schema))
    return docs.mapInArrow(trimmed(run), docs.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
