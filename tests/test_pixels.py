"""PNG decoding against an encoder that knows every filter and layout, refused files, and hashes by plain loops."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.sources import images, readers


def part(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def packed(samples, depth):
    """Rows of samples (list of lists) as bytes."""
    out = []
    for row in samples:
        bits = "".join(f"{v:0{depth}b}" for v in row)
        out.append(int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big"))
    return out


def filtered(rows, step, kinds):
    out, before = b"", bytes(len(rows[0])) if rows else b""
    for row, kind in zip(rows, kinds, strict=False):
        line = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        out, before = out + bytes([kind]) + bytes(line), row
    return out


def png(pixels, colour, depth, interlaced=False, kinds=None, palette=None, split=7):
    """pixels: rows of tuples of samples."""
    height, width = len(pixels), len(pixels[0])
    r = random.Random(1)
    raw = b""
    for y, x, dy, dx in images.PASSES if interlaced else ((0, 0, 1, 1),):
        rows = packed([[v for p in row[x::dx] for v in p] for row in pixels[y::dy]], depth)
        if rows and rows[0]:
            raw += filtered(rows, max(1, len(pixels[0][0]) * depth // 8), [r.choice(kinds or range(5)) for _ in rows])
    body = zlib.compress(raw)
    out = images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))) + part(b"tEXt", b"x")
    if palette:
        out += part(b"PLTE", bytes(v for p in palette for v in p))
    return out + b"".join(part(b"IDAT", body[i : i + split * 50]) for i in range(0, len(body), split * 50)) + part(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, (_, _, depths) in images.MODES.items() for d in depths])
def test_every_layout_is_decoded(colour, depth, interlaced):
    r = random.Random(colour * 100 + depth)
    channels, mode, _ = images.MODES[colour]
    for width, height in ((1, 1), (3, 2), (13, 9), (33, 17)):
        palette = [tuple(r.randrange(256) for _ in range(3)) for _ in range(min(200, 1 << depth))] if colour == 3 else None
        pixels = [[tuple(r.randrange(len(palette) if palette else 1 << depth) for _ in range(channels)) for _ in range(width)] for _ in range(height)]
        eight = lambda v: v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1)
        want = [[palette[p[0]] if palette else tuple(map(eight, p[:3])) if channels > 2 else (eight(p[0]),) * 3 for p in row] for row in pixels]
        for kinds in (None, (0, 1, 2)):
            got, said = images.decoded(png(pixels, colour, depth, interlaced, kinds, palette))
            assert said == mode and got.tolist() == [list(map(list, row)) for row in want]


def test_what_is_wrong_is_told():
    r = random.Random(3)
    pixels = [[tuple(r.randrange(256) for _ in range(3)) for _ in range(40)] for _ in range(30)]
    good = png(pixels, 2, 8)
    assert images.decoded(good + b"after the end")[0].shape == (30, 40, 3)
    at = good.index(b"IDAT")
    head = lambda *v: images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", *v)) + good[33:]
    cases = {
        "no PNG signature": [b"", b"GIF89a", good[1:]],
        "cut off": [good[:n] for n in (10, 40, len(good) // 2, len(good) - 13, len(good) - 1)],
        "broken chunk": [good[: at + 30] + bytes([good[at + 30] ^ 1]) + good[at + 31 :], good[:20] + b"\1" + good[21:]],
        "broken header": [head(40, 30, 3, 2, 0, 0, 0), head(40, 30, 8, 5, 0, 0, 0), head(0, 30, 8, 2, 0, 0, 0), head(1 << 20, 1 << 20, 8, 2, 0, 0, 0), head(40, 30, 8, 2, 0, 0, 2)],
        "pixels missing": [head(40, 31, 8, 2, 0, 0, 0), head(41, 30, 8, 2, 0, 0, 0), good[: at - 4] + part(b"IEND", b"")],
        "too many pixels": [head(40, 29, 8, 2, 0, 0, 0)],
        "broken pixel data": [good[: at - 4] + part(b"IDAT", b"no deflate stream") + part(b"IEND", b"")],
        "header missing or repeated": [images.SIGNATURE + good[33:], good[:33] + good[8:]],
        "unknown filter": [good[: at - 4] + part(b"IDAT", zlib.compress((b"\5" + bytes(120)) * 30)) + part(b"IEND", b"")],
        "palette missing or too short": [png([[(3,)]], 3, 8, palette=[(1, 2, 3)]), png([[(0,)]], 3, 8)],
    }
    for reason, files in cases.items():
        for f in files:
            with pytest.raises(ValueError, match=reason):
                images.decoded(f)
    bomb = good[: at - 4] + part(b"IDAT", zlib.compress(bytes(200 << 20), 9)) + part(b"IEND", b"")
    with pytest.raises(ValueError, match="too many pixels"):
        images.decoded(bomb)


def slow_hash(rgb):
    """The hash by loops over single pixels."""
    luma = [[(r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 for r, g, b in row] for row in rgb]

    def resized(line, to):
        scale, out = len(line) / to, []
        if len(line) == to:
            return line
        wide = max(1.0, scale)
        for i in range(to):
            c = (i + 0.5) * scale
            a, b = max(0, int(c - 3 * wide + 0.5)), min(len(line), int(c + 3 * wide + 0.5))
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            w = [sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0 for t in ((x - c + 0.5) / wide for x in range(a, b))]
            whole = [math.floor(v / sum(w) * 4194304 + 0.5) for v in w]
            out.append(min(255, max(0, (sum(p * v for p, v in zip(line[a:b], whole, strict=True)) + 2097152) >> 22)))
        return out

    rows = [resized(row, 64) for row in luma]
    columns = [resized(list(c), 64) for c in zip(*rows, strict=True)]
    cosine = [[2 * math.cos(math.pi * k * (2 * n + 1) / 128) for n in range(64)] for k in range(16)]
    one = [[sum(columns[x][y] * cosine[k][y] for y in range(64)) for x in range(64)] for k in range(16)]
    low = [round(sum(one[k][x] * cosine[u][x] for x in range(64)), 6) for k in range(16) for u in range(16)]
    middle = sorted(low)
    median = (middle[127] + middle[128]) / 2
    return f"{int(''.join('1' if v > median else '0' for v in low), 2):064x}"


@pytest.mark.parametrize(("width", "height"), [(64, 64), (200, 90), (64, 31), (7, 150), (1, 1), (640, 64)])
def test_hashes_by_loops(width, height):
    r = np.random.default_rng(width)
    y, x = np.mgrid[:height, :width]
    pixels = np.stack([(x * 3 + y) % 256, (x * y) % 251, r.integers(0, 256, (height, width))], 2).astype(np.uint8)
    assert images.perceptual_hash(pixels) == slow_hash(pixels.tolist())


def test_copies_at_other_sizes_are_near():
    pixels = np.repeat(np.kron(np.random.default_rng(1).integers(0, 256, (32, 32)), np.ones((8, 8))).astype(np.uint8)[..., None], 3, 2)
    small = images.scaled(images.grey(pixels), 128, 128)
    a, b = images.perceptual_hash(pixels), images.perceptual_hash(images.decoded(images.encoded(small))[0])
    assert (int(a, 16) ^ int(b, 16)).bit_count() <= 10
    other = images.perceptual_hash(pixels[::-1])
    assert (int(a, 16) ^ int(other, 16)).bit_count() > 60


def test_scan_tells_hash_or_reason(spark):
    good = images.encoded(np.arange(100, dtype=np.uint8).reshape(10, 10))
    rows = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:-3])), ("c", bytearray(b"\xff\xd8\xff\xe0"))], "path string, content binary")
    got = {r.path: r for r in readers.scanned(rows).collect()}
    assert (got["a"].width, got["a"].mode, got["a"].phash, got["a"].reason) == (10, "L", images.perceptual_hash(images.decoded(good)[0]), None)
    assert (got["b"].reason, got["b"].phash, got["c"].reason) == ("cut off", None, "cut off")
