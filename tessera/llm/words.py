"""Words of a whole Arrow batch of texts at once: distinct words, each occurrence's word, and where texts and pieces end."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: What a byte is: part of a word, a gap between words, or the end of a piece (a gap that no phrase spans).
WORD, GAP, STOP = range(3)
#: A-Z as a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8) + np.uint8(32) * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


def kinds(gaps: bytes, stops: bytes = b"") -> np.ndarray:
    """The kind of each byte (after lower-casing, if the splitter does that)."""
    k = np.full(256, WORD, np.uint8)
    k[list(gaps)] = GAP
    k[list(stops)] = STOP
    return k


#: Words of ASCII letters, digits and all characters beyond ASCII, in lower case: gaps are 00-2F, 3A-60, 7B-7F.
PLAIN = kinds(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Words between white space of ASCII: 20, 09-0D.
SPACED = kinds(bytes([0x20, *range(0x09, 0x0E)]))


class Words(NamedTuple):
    """distinct: the words; codes: of each occurrence, in the texts' order; ends: occurrences up to each text's end, from
    0 on; pieces: of each occurrence, the number of the piece that it stands in (of the whole batch)."""

    distinct: pa.Array
    codes: np.ndarray
    ends: np.ndarray
    pieces: np.ndarray

    def lengths(self) -> np.ndarray:
        """Bytes of each distinct word."""
        return np.diff(np.frombuffer(self.distinct.buffers()[1], np.int64)[self.distinct.offset : self.distinct.offset + len(self.distinct) + 1])


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def split(texts: pa.Array, kind: np.ndarray, fold: Callable[[np.ndarray], np.ndarray] | None = lowered, breaks: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """The words of the texts; null texts have none, and no word or piece reaches into the next text. fold changes bytes
    for bytes; breaks says, of all bytes but the first, which begin a word though one goes on before them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return Words(pa.array([], pa.large_binary()), np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = fold(data) if fold else data
    of = kind[data]
    inside = of == WORD
    first = inside.copy()
    first[1:] &= ~inside[:-1] | breaks(data) if breaks else ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts, letters = np.flatnonzero(first), data[inside]
    at = np.append(np.flatnonzero(first[inside]), len(letters)).astype(np.int64)
    all_words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = all_words.dictionary_encode()
    ends = np.searchsorted(starts, offsets)
    stops = np.flatnonzero(of == STOP)
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ends, np.searchsorted(stops, starts) + np.searchsorted(offsets, starts, "right"))
