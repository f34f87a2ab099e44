"""Image copies: decoding, descriptors, recall by edit, agreement with an all-pairs search, odd rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import images


def vectors(spark, ids):
    return spark.createDataFrame([(k, np.random.default_rng(k).normal(size=64).tolist()) for k in ids], "vec_id long, embedding array<double>")


def png(pixels, kind, colour, palette=b""):
    """A PNG whose rows all have one filter, written by the letter of the format."""
    height, width, channels = pixels.shape
    lines, above = b"", [0] * (width * channels)
    for row in pixels.reshape(height, -1).astype(int).tolist():
        line = []
        for i, value in enumerate(row):
            left = row[i - channels] if i >= channels else 0
            corner = above[i - channels] if i >= channels else 0
            guess = (0, left, above[i], (left + above[i]) // 2, None)[kind]
            if guess is None:
                p = left + above[i] - corner
                near = [abs(p - left), abs(p - above[i]), abs(p - corner)]
                guess = (left, above[i], corner)[near.index(min(near))]
            line.append((value - guess) % 256)
        lines += bytes([kind, *line])
        above = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return images._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png(kind):
    rng = np.random.default_rng(kind)
    grey = rng.integers(0, 256, (9, 7, 1))
    assert np.array_equal(images.decode(png(grey, kind, 0)), grey[:, :, 0])
    colour = rng.integers(0, 256, (6, 5, 3))
    assert np.allclose(images.decode(png(colour, kind, 2)), colour @ [0.299, 0.587, 0.114], atol=1e-3)
    assert np.allclose(images.decode(png(np.dstack([colour, grey[:6, :5]]), kind, 6)), colour @ [0.299, 0.587, 0.114], atol=1e-3)
    table = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    index = rng.integers(0, 4, (5, 5, 1))
    assert np.allclose(images.decode(png(index, kind, 3, table.tobytes())), table[index[:, :, 0]] @ [0.299, 0.587, 0.114], atol=1e-3)


def test_bad_pictures():
    whole = images.to_png(np.arange(48).reshape(6, 8))
    assert np.array_equal(images.decode(whole), np.arange(48).reshape(6, 8))
    broken = bytearray(whole)
    broken[45] ^= 255
    for data in (None, b"", b"junk", whole[:40], bytes(broken), b"P5\n4 4\n255\nabc", b"P5\nx\n255\n"):
        assert images.decode(data) is None
    assert np.array_equal(images.decode(images.to_pgm(np.arange(6).reshape(2, 3))), np.arange(6).reshape(2, 3))


def test_every_edit_is_found(spark):
    """Recall by edit on pictures of their own seeds; a turn by 15 degrees is the weak one."""
    ids = range(20 * 400, 20 * 480, 20)
    df = vectors(spark, ids)
    got = {(r["query_id"], r["media_id"]) for r in images.search(images.media(df), images.media(df, edit=True)).collect()}
    found = {k: np.mean([(v, v) in got for v in ids if v // 20 % 8 == k]) for k in range(8)}
    assert np.mean(list(found.values())) >= 0.9 and min(found[k] for k in range(7)) >= 0.8
    assert len([p for p in got if p[0] != p[1]]) <= 1


def test_search_is_that_of_all_pairs(spark):
    """Every pair that shares keys and has a consensus, found by comparing all pairs in numpy."""
    ids = range(0, 20 * 24, 20)
    df = vectors(spark, ids)
    rows = [(r["media_id"], bytes(r["image"])) for r in images.media(df).collect()]
    asked = [(r["media_id"], bytes(r["image"])) for r in images.media(df, edit=True).collect()]

    def keys(bits):
        width = images.BITS // images.TABLES // 8
        bands = {(k, line[k * width : (k + 1) * width].tobytes()) for line in bits for k in range(images.TABLES)}
        return {(k, b) for k, b in bands if images.PLAIN <= int.from_bytes(b).bit_count() <= 8 * width - images.PLAIN}

    want = set()
    views = {m: keys(images.describe(images.decode(x), images.QUERY_SCALES, images.QUERY_TURNS)[1]) for m, x in asked}
    plain = {m: images.describe(images.decode(x), images.MATCH_SCALES) for m, x in asked}
    own = {m: images.describe(images.decode(x)) for m, x in rows}
    for query, (q, qb) in plain.items():
        for media, (t, tb) in own.items():
            if len(views[query] & keys(tb)) < 2:
                continue
            apart = np.unpackbits(tb[:, None] ^ qb[None], axis=2).sum(axis=2)
            good = apart.min(axis=1) <= 67
            if good.sum() >= 6:
                n, a, b = images.consensus(q[apart.argmin(axis=1)[good]].astype("<f4").astype(float), t[good].astype("<f4").astype(float))
                if n >= 6:
                    want.add((query, media, n))
    got = images.search(images.media(df), images.media(df, edit=True)).where("matches is not null").collect()
    assert {(r["query_id"], r["media_id"], r["matches"]) for r in got} == want and len(want) >= 20


def test_consensus_finds_the_transform():
    rng = np.random.default_rng(0)
    q = rng.uniform(0, 64, (40, 2))
    a, b = 0.8 * np.exp(0.3j), 5 - 2j
    z = a * (q[:, 1] + 1j * q[:, 0]) + b
    t = np.column_stack([z.imag, z.real])
    t[25:] = rng.uniform(0, 64, (15, 2))
    n, found_a, found_b = images.consensus(q, t)
    assert 25 <= n <= 28 and abs(found_a - a) < 0.1 and abs(found_b - b) < 4
    assert images.consensus(q[:1], t[:1])[0] == 0


def test_copies_without_corners_and_odd_rows(spark):
    """Equal pixels are found whatever the format; unreadable and empty pictures are alone; ids may repeat or be null."""
    flat = np.full((30, 30), 9)
    rows = [(40, images.to_png(flat)), (41, images.to_pgm(flat)), (42, images.to_pgm(flat)), (43, b"junk"), (44, None), (45, b""), (46, b""), (None, images.to_png(flat)), (60, images.to_png(flat + 1)), (60, images.to_png(flat + 1)), (60, images.to_png(flat + 2)), (80, b"junk"), (100, b"")]
    df = spark.createDataFrame(rows, "media_id long, image binary").withColumn("digest", F.lit("x")).withColumn("row", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted((r["query_id"], r["media_id"], r["members"]) for r in images.search(df, df.where("media_id % 20 = 0")).collect())
    assert got == [(40, 40, 3), (60, 60, 1), (60, 60, 2), (80, 43, 2), (100, 100, 1)]
    assert images.search(df.limit(0), df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [0.0] * 64), (20, None), (40, [1.0])], "vec_id long, embedding array<double>")
    assert images.media(odd, edit=True).count() == 3 and images.search(images.media(odd), images.media(odd)).count() == 2


def test_a_large_picture_has_more_corners():
    rng = np.random.default_rng(1)
    small = np.kron(rng.integers(0, 255, (12, 12)), np.ones((6, 6))).astype(np.float32)
    assert len(images.describe(np.tile(small, (3, 3)))[0]) > 6 * len(images.describe(small)[0]) > 0
    large = np.kron(rng.integers(0, 255, (50, 70)), np.ones((20, 20))).astype(np.float32)
    places, _ = images.describe(large)
    assert 100 < len(places) <= (images.LARGEST // images.CELL + 1) ** 2 and places.max() > 1100  # in the picture's own pixels


def test_consensus_of_very_many_matches():
    rng = np.random.default_rng(2)
    q = rng.uniform(0, 500, (1500, 2))
    t = q[:, ::-1] * [1, -1] * 0.5 + 40  # turned and made smaller
    t[::3] = rng.uniform(0, 500, (500, 2))
    n, a, _ = images.consensus(q, t)
    assert n >= 990 and abs(abs(a) - 0.5) < 0.02
