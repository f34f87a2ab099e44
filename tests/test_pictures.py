"""Pictures: decoding of every kind of PNG, resampling and hashes pixel by pixel, padding, sheets, odd files."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.sources import pictures


def filtered(lines, step):
    """Lines (bytes) under the five filters in turn, byte by byte."""
    out, above = b"", bytes(len(lines[0]))
    for k, line in enumerate(lines):
        kind = k % 5
        made = bytearray([kind])
        for i, v in enumerate(line):
            a = line[i - step] if i >= step else 0
            b, c = above[i], above[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            made.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out, above = out + bytes(made), line
    return out


@pytest.mark.parametrize(("kind", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
@pytest.mark.parametrize("interlaced", [False, True])
def test_png_of_any_kind(kind, depth, interlaced):
    rng = np.random.default_rng(kind * 100 + depth)
    width, height, samples = 11, 13, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    values = rng.integers(0, 1 << depth, (height, width, samples))
    palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)

    def lines(part):
        rows = []
        for row in part:
            bits = "".join(format(int(v), f"0{depth}b") for v in row.reshape(-1))
            rows.append(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"))
        return filtered(rows, max(1, samples * depth // 8)) if rows and rows[0] else b""

    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if interlaced else [(0, 0, 1, 1)]
    data = pictures.png_of(width, height, depth, kind, b"".join(lines(values[r::dr, c::dc]) for r, c, dr, dc in passes), palette.tobytes() if kind == 3 else None, interlaced)
    eight = values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))
    want = palette[values[..., 0]] if kind == 3 else eight[..., :3] if samples > 2 else np.repeat(eight[..., :1], 3, axis=2)
    assert np.array_equal(pictures.decode(data), want)


def test_broken_files_are_errors():
    whole = pictures.encode_png(np.zeros((5, 4, 3), dtype=np.uint8))
    short = pictures.png_of(4, 5, 8, 2, bytes(13 * 4))
    for data in (None, b"", b"text", whole[:-20], whole[:30], whole[:45] + b"\0" + whole[46:], short, pictures.png_of(2, 1, 8, 3, bytes([0, 0, 9]), bytes(6)), b"P6 4 4 255\n123", whole[:8] + struct.pack(">I4s", 0, b"IEND") + struct.pack(">I", zlib.crc32(b"IEND"))):
        with pytest.raises((ValueError, zlib.error)):
            pictures.decode(data)
    assert pictures.decode(b"P5\n# grey\n2 1 255\n\x07\x09").tolist() == [[[7] * 3, [9] * 3]]


def plain_resize(grey, size, out):
    """One axis of a list of lists, pixel by pixel, in whole numbers."""
    scale = size / out
    wide = max(scale, 1.0)
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    result = []
    for o in range(out):
        mid = (o + 0.5) * scale
        low, high = max(int(mid - 3 * wide + 0.5), 0), min(int(mid + 3 * wide + 0.5), size)
        w = [sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0 for t in ((i - mid + 0.5) / wide for i in range(low, high))]
        w = [math.copysign(math.floor(abs(v / sum(w)) * 2**22 + 0.5), v) for v in w]
        result.append([min(255, max(0, (sum(int(v) * row[i] for v, i in zip(w, range(low, high), strict=True)) + 2**21) >> 22)) for row in grey])
    return [list(r) for r in zip(*result, strict=True)]


@pytest.mark.parametrize("shape", [(8, 9), (1, 1), (5, 4), (40, 61), (8, 30), (33, 9)])
def test_hash_pixel_by_pixel(shape):
    pixels = np.random.default_rng(sum(shape)).integers(0, 256, (*shape, 3), dtype=np.uint8)
    grey = [[(int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 32768) >> 16 for r, g, b in row] for row in pixels]
    small = plain_resize(grey, shape[1], 9) if shape[1] != 9 else grey
    small = [list(r) for r in zip(*(plain_resize([list(c) for c in zip(*small, strict=True)], shape[0], 8)), strict=True)] if shape[0] != 8 else small
    assert pictures.resized(pictures.luminance(pixels), 9, 8).tolist() == small
    bits = "".join("1" if row[k] > row[k + 1] else "0" for row in small for k in range(8))
    assert pictures.difference_hash(pixels) % 2**64 == int(bits, 2)


def test_padding_and_sheets_pixel_by_pixel():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    padded = pictures.edge_padded(p, 2)
    assert all((padded[y, x] == p[min(max(y - 2, 0), 2), min(max(x - 2, 0), 4)]).all() for y in range(7) for x in range(9)) and padded.shape == (7, 9, 3)
    tiles = [rng.integers(0, 256, (2, 3, 3), dtype=np.uint8) for _ in range(9)]
    made = pictures.sheet(tiles)
    assert made.shape == (4, 21, 3)
    for y in range(4):
        for x in range(21):
            k = y // 2 * 7 + x // 3
            assert (made[y, x] == (tiles[k][y % 2, x % 3] if k < 9 else 255)).all()
    assert pictures.fitted(np.full((2, 4, 3), 90, dtype=np.uint8), 8)[:, 0, 0].tolist() == [0, 0, 90, 90, 90, 90, 0, 0]


def test_facts_of_odd_rows(spark):
    good = pictures.encode_png(np.arange(8 * 9 * 3, dtype=np.uint8).reshape(8, 9, 3))
    rows = [("a", bytearray(good)), ("a", bytearray(good)), ("b", None), ("c", bytearray()), (None, bytearray(b"text"))]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("width", F.lit("x")).withColumn("_content", F.lit(1))
    got = {(r["path"], r["width"], r["dhash"] is None, r["error"] is None) for r in pictures.picture_facts(df).collect()}
    assert got == {("a", 9, False, True), ("b", None, True, False), ("c", None, True, False), (None, None, True, False)}
    assert pictures.picture_facts(df.limit(0)).count() == 0
