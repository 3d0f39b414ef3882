"""PNG bytes: without metadata, strictly decoded to pixels, encoded, and their perceptual hash.

Every checksum, the header's values, the length of the pixel data and its end are checked; what is wrong is a ValueError
with its reason. Pixel data is inflated in steps and never beyond what the header announces, so a small file can't grow
without bound. Samples of 16 bits count with their upper 8, alpha is dropped.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed: chunks that pixels need.
CHUNKS = (b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS")
#: Fixed: colour types with their channels, the mode they decode to and the depths they may have; where the passes of an
#: interlaced image start, and their steps.
MODES = {0: (1, "L", (1, 2, 4, 8, 16)), 2: (3, "RGB", (8, 16)), 3: (1, "P", (1, 2, 4, 8)), 4: (2, "LA", (8, 16)), 6: (4, "RGBA", (8, 16))}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
#: Pixels of an image at most, and bytes that are inflated at once.
MOST, STEP = 1 << 28, 1 << 16
#: Side of the scaled image and of the hash's square of frequencies.
SIDE, HASH = 64, 16


def without_metadata(data: bytes) -> bytes:
    """A PNG's pixel chunks; other formats as they are. A file that ends early raises ValueError."""
    if not data.startswith(SIGNATURE):
        return data
    out, at, kind = [SIGNATURE], len(SIGNATURE), b""
    while kind != b"IEND":
        if at + 8 > len(data):
            raise ValueError("truncated PNG")
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + size + 12
        if kind in CHUNKS:
            if end > len(data):
                raise ValueError("truncated PNG chunk")
            out.append(data[at:end])
        at = end
    return b"".join(out)


def sanitized(files: DataFrame) -> DataFrame:
    """path, content, width, height, error: a broken file becomes a row with its error, not a failed job. files: path, content."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    clean = without_metadata(bytes(data))
                    png = clean.startswith(SIGNATURE) and clean[12:16] == b"IHDR"
                    out.append((path, clean, *(struct.unpack_from(">II", clean, 16) if png else (None, None)), None))
                except ValueError as e:
                    out.append((path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "content", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(rows, "path string, content binary, width long, height long, error string")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk up to the end's, with checked checksums."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, kind = len(SIGNATURE), b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise ValueError("cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"broken chunk at byte {at}")
        yield kind, body
        at += 12 + size


def _inflated(parts: list[bytes], size: int) -> bytes:
    """Exactly so many bytes, which must be all there are."""
    z, out, left = zlib.decompressobj(), bytearray(), memoryview(b"".join(parts))
    try:
        while left and not z.eof and len(out) <= size:
            todo = bytes(left[:STEP])
            left = left[STEP:]
            while todo and len(out) <= size and not z.eof:
                out += z.decompress(todo, size + 1 - len(out))
                todo = z.unconsumed_tail
    except zlib.error as e:
        raise ValueError("broken pixel data") from e
    if len(out) > size:
        raise ValueError("too many pixels")
    if len(out) < size or not z.eof:
        raise ValueError("pixels missing")
    return bytes(out)


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows whose filters are undone; step: bytes from a sample to the one on its left.

    A byte needs those to its left, above, and above left, so all rows' bytes of one diagonal are done at once.
    """
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    height, width = rows.shape
    cells = rows.reshape(height, width // step, step).astype(np.int16)
    if (kinds <= 2).all():
        out = cells
        for y in range(height):
            if kinds[y] == 1:
                out[y] = np.cumsum(out[y], 0, dtype=np.int64) & 255
            elif kinds[y] == 2 and y:
                out[y] = (out[y] + out[y - 1]) & 255
        return out.reshape(height, width).astype(np.uint8)
    columns = cells.shape[1]
    out = np.zeros((height + 1, columns + 1, step), np.int16)
    for d in range(height + columns - 1):
        y = np.arange(max(0, d - columns + 1), min(height, d + 1))
        x = d - y
        left, above, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y, None]
        guess = left + above - corner
        to_left, to_above, to_corner = abs(guess - left), abs(guess - above), abs(guess - corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
        out[y + 1, x + 1] = (cells[y, x] + add) & 255
    return out[1:, 1:].reshape(height, width).astype(np.uint8)


def _samples(raw: bytes, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """Samples of an image or of one pass: height x width x channels, as stored (of 16 bits the upper 8)."""
    line = (width * channels * depth + 7) // 8
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    got = _unfiltered(rows[:, 0], rows[:, 1:], max(1, channels * depth // 8))
    if depth == 16:
        got = got[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(got, axis=1).reshape(height, -1, depth)
        got = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : width * channels]
    return got.reshape(height, width, channels)


def decoded(data: bytes) -> tuple[np.ndarray, str]:
    """RGB pixels (height x width x 3) of a PNG, and the mode it is stored in."""
    head, palette, pixels = None, None, []
    for kind, body in chunks(data):
        if (kind == b"IHDR") != (head is None):
            raise ValueError("header missing or repeated")
        if kind == b"IHDR":
            if len(body) != 13:
                raise ValueError("broken header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            pixels.append(body)
    width, height, depth, colour, packing, filtering, interlaced = head
    if colour not in MODES or depth not in MODES[colour][2] or packing or filtering or interlaced > 1 or not 0 < width * height <= MOST:
        raise ValueError("broken header")
    channels, mode, _ = MODES[colour]
    passes = [(y, x, dy, dx, -(-(width - x) // dx), -(-(height - y) // dy)) for y, x, dy, dx in (PASSES if interlaced else ((0, 0, 1, 1),))]
    passes = [p for p in passes if p[4] > 0 and p[5] > 0]
    sizes = [((w * channels * depth + 7) // 8 + 1) * h for *_, w, h in passes]
    raw, out, at = _inflated(pixels, sum(sizes)), np.empty((height, width, channels), np.uint8), 0
    for (y, x, dy, dx, w, h), size in zip(passes, sizes, strict=True):
        out[y::dy, x::dx] = _samples(raw[at : at + size], w, h, channels, depth)
        at += size
    if colour == 3:
        if palette is None or not palette or len(palette) % 3 or out.max() >= len(palette) // 3:
            raise ValueError("palette missing or too short")
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[out[..., 0]], mode
    if depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    return (out[..., :3] if channels > 2 else np.repeat(out[..., :1], 3, 2)), mode


def encoded(pixels: np.ndarray) -> bytes:
    """A PNG of grey (height x width) or RGB pixels of 8 bits, unfiltered."""
    height, width = pixels.shape[:2]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], 1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB pixels, in integers."""
    weights = np.array([19595, 38470, 7471])
    return ((pixels.astype(np.int64) @ weights + (1 << 15)) >> 16).astype(np.uint8)


@lru_cache(maxsize=64)
def _lanczos(size: int, to: int) -> np.ndarray:
    """Weights (to x size) of a windowed sinc of three lobes, widened where the image shrinks, in steps of 2 ** -22."""
    scale = size / to
    wide = max(scale, 1.0)
    out = np.zeros((to, size))
    for i in range(to):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - 3 * wide + 0.5)), min(size, int(centre + 3 * wide + 0.5))
        x = (np.arange(first, last) - centre + 0.5) / wide
        w = np.where(abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
        out[i, first:last] = w / w.sum()
    return np.floor(out * (1 << 22) + 0.5)


def scaled(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """Grey pixels at another size, each direction rounded to whole values."""
    whole = lambda x: np.clip(np.floor(x / (1 << 22) + 0.5), 0, 255)
    out = values.astype(float)
    if values.shape[1] != width:
        out = whole(out @ _lanczos(values.shape[1], width).T)
    if values.shape[0] != height:
        out = whole(_lanczos(values.shape[0], height) @ out)
    return out.astype(np.uint8)


def perceptual_hash(pixels: np.ndarray) -> str:
    """256 bits as 64 hex digits: which of the 16 x 16 lowest frequencies of the grey image at 64 x 64, rounded so that a
    flat one has none but the lowest, are over their median."""
    n, k = np.arange(SIDE), np.arange(HASH)
    cosines = 2 * np.cos(math.pi * k[:, None] * (2 * n[None] + 1) / (2 * SIDE))
    low = np.round(cosines @ scaled(grey(pixels), SIDE, SIDE).astype(float) @ cosines.T, 6)
    return np.packbits(low > np.median(low)).tobytes().hex()
