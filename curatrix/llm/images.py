"""Media columns: local image descriptors that find cropped or edited copies.

Pictures (PNG or binary PGM/PPM in a column; other formats where Pillow is
installed) become grey, and are searched for corners at several scales: the
strongest of every ``CELL`` x ``CELL`` pixels, so their number goes with the
picture's area. Each corner's patch is turned by its intensity centroid, and pairs
of points in it are compared, which gives ``BITS`` bits.

Pictures with the same pixels are one class, described once; such copies, with
corners or without, are found by that alone. Classes are described at their own
scale, queries at several, with patches turned a little either way beside, so the
work for edits is done on the queries' side. Descriptors meet in ``TABLES``
tables, keyed by one band of bits each (and the table's number), so only those
that agree on a band are compared. Of a pair that shares ``votes`` keys, nearest
descriptors within ``max_bits`` differing bits are matched, every two matches
propose a turn, scale and shift, and the largest set of matches that agree with
one is the consensus; a pair with ``least`` agreeing matches is a copy.

The queries are stated: every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import durable, hinted, table

BITS = 336
TABLES = 6
RADIUS = 9
CELL = 8
#: Scales at which queries are described (classes: 1 alone), and turns of their patches about the measured one.
QUERY_SCALES = (1.33, 1.15, 1.0, 0.93, 0.87, 0.81, 0.76)
QUERY_TURNS = (-0.15, 0.0, 0.15)
#: Scales of a query whose descriptors are matched with a candidate's.
MATCH_SCALES = (1.33, 1.0, 0.81)
SIDE = 72
#: Longer side, in pixels, at which a picture is described at most; a larger one is made smaller first.
LARGEST = 512
#: Pairs of matches that propose a transform at most, spread evenly over all; all matches vote.
PROPOSALS = 20_000
#: Least bits of either kind in a band that makes a key.
PLAIN = 11

_rng = np.random.default_rng(3)
#: Point pairs of the binary tests, normal around the patch's centre.
_PAIRS = np.clip(_rng.normal(0, 0.7 * RADIUS, (BITS, 4)), -RADIUS + 1, RADIUS - 1)
_YX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_YX[0] ** 2 + _YX[1] ** 2) <= RADIUS**2
_PNG = b"\x89PNG\r\n\x1a\n"


def to_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def to_png(image: np.ndarray) -> bytes:
    """A grey PNG; every row is coded as its difference from the row above."""
    grey = image.astype(np.uint8)
    above = np.vstack([np.zeros((1, grey.shape[1]), dtype=np.uint8), grey[:-1]])
    rows = np.column_stack([np.full(len(grey), 2, dtype=np.uint8), grey - above])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Luminance of one, two (with opacity), three or four channels."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.float32)
    return (pixels[:, :, :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], dtype=np.float32)).astype(np.float32)


def from_png(data: bytes) -> np.ndarray | None:
    """An 8-bit PNG that is not interlaced, as grey floats; None for others."""
    at, body, palette, head = len(_PNG), b"", b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            return None
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = part
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
    if min(width, height) < 1 or len(raw) < height * (1 + width * channels):
        return None
    lines = raw[: height * (1 + width * channels)].reshape(height, -1)
    out = np.zeros((height, width * channels), dtype=np.uint8)
    above = np.zeros(width * channels, dtype=np.uint8)
    for k, (kind, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
        if kind == 0:
            above = line
        elif kind == 1:
            above = np.cumsum(line.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            above = line + above
        elif kind in (3, 4):
            own, up = line.tolist(), above.tolist()
            for i in range(len(own)):
                left = own[i - channels] if i >= channels else 0
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    corner = up[i - channels] if i >= channels else 0
                    guess = min((abs(up[i] - corner), 0, left), (abs(left - corner), 1, up[i]), (abs(left + up[i] - 2 * corner), 2, corner))[2]
                own[i] = (own[i] + guess) & 255
            above = np.array(own, dtype=np.uint8)
        else:
            return None
        out[k] = above
    if head[3] == 3:
        colours = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)
        if out.max() >= len(colours):
            return None
        return _grey(colours[out])
    return _grey(out.reshape(height, width, channels))


def decode(data: bytes | None) -> np.ndarray | None:
    """A picture's grey floats; None for what cannot be read."""
    try:
        if data[:8] == _PNG:
            return from_png(data)
        if data[:2] in (b"P5", b"P6"):
            _, size, top, rest = data.split(b"\n", 3)
            width, height = map(int, size.split())
            channels = 1 if data[:2] == b"P5" else 3
            if top != b"255" or len(rest) < width * height * channels or min(width, height) < 1:
                return None
            return _grey(np.frombuffer(rest, dtype=np.uint8, count=width * height * channels).reshape(height, width, channels))
    except (TypeError, ValueError, struct.error, zlib.error):
        return None
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("L"), dtype=np.float32)
    except (OSError, ValueError, TypeError):
        return None


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return (top * (1 - fy) + low * fy).astype(np.float32)


def smooth(image: np.ndarray, times: int = 2) -> np.ndarray:
    for _ in range(times):
        p = np.pad(image, 1, mode="edge")
        image = (p[:-2, 1:-1] + 2 * p[1:-1, 1:-1] + p[2:, 1:-1]) / 4
        p = np.pad(image, 1, mode="edge")
        image = (p[1:-1, :-2] + 2 * p[1:-1, 1:-1] + p[1:-1, 2:]) / 4
    return image


def corners(image: np.ndarray) -> np.ndarray:
    """(row, column) of the strongest corner of every cell whose patch lies inside, by the structure tensor."""
    gy, gx = np.gradient(image)
    a, b, c = smooth(gx * gx), smooth(gx * gy), smooth(gy * gy)
    r = (a * c - b * b - 0.05 * (a + c) ** 2)[RADIUS:-RADIUS, RADIUS:-RADIUS]
    p = np.pad(r, 1, constant_values=-np.inf)
    rows = np.maximum(np.maximum(p[:-2], p[1:-1]), p[2:])
    around = np.maximum(np.maximum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
    at = np.argwhere((r >= around) & (r > 1e-3))
    strength = r[at[:, 0], at[:, 1]]
    cell = (at[:, 0] // CELL) * (r.shape[1] // CELL + 1) + at[:, 1] // CELL
    by = np.lexsort((at[:, 1], at[:, 0], -strength, cell))
    first = np.ones(len(by), dtype=bool)
    first[1:] = cell[by][1:] != cell[by][:-1]
    return at[by[first]] + RADIUS


def describe(image: np.ndarray, scales: tuple[float, ...] = (1.0,), turns: tuple[float, ...] = (0.0,)) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column in the image's own pixels) and packed bits of all descriptors."""
    places, bits = [], []
    fit = min(1.0, LARGEST / max(image.shape))
    for scale in (fit * s for s in scales):
        height, width = round(image.shape[0] * scale), round(image.shape[1] * scale)
        if min(height, width) <= 2 * RADIUS + 1:
            continue
        level = smooth(image if scale == 1.0 else resize(image, height, width), 1)
        at = corners(level)
        if not len(at):
            continue
        patch = level[at[:, 0, None, None] + _YX[0], at[:, 1, None, None] + _YX[1]] * _DISC
        angle = np.arctan2((patch * _YX[0]).sum(axis=(1, 2)), (patch * _YX[1]).sum(axis=(1, 2)))
        soft = smooth(level, 1)
        for turn in turns:
            cos, sin = np.cos(angle + turn)[:, None], np.sin(angle + turn)[:, None]

            def sample(y: np.ndarray, x: np.ndarray, cos: np.ndarray = cos, sin: np.ndarray = sin) -> np.ndarray:
                yy = np.clip(np.rint(at[:, 0, None] + y * cos + x * sin).astype(int), 0, soft.shape[0] - 1)  # noqa: B023
                xx = np.clip(np.rint(at[:, 1, None] + x * cos - y * sin).astype(int), 0, soft.shape[1] - 1)  # noqa: B023
                return soft[yy, xx]  # noqa: B023

            bits.append(np.packbits(sample(_PAIRS[:, 0], _PAIRS[:, 1]) < sample(_PAIRS[:, 2], _PAIRS[:, 3]), axis=1))
            places.append((at + 0.5) * [image.shape[0] / height, image.shape[1] / width] - 0.5)
    if not bits:
        return np.empty((0, 2)), np.empty((0, BITS // 8), dtype=np.uint8)
    return np.concatenate(places), np.concatenate(bits)


def consensus(q: np.ndarray, t: np.ndarray, tolerance: float = 2.5, apart: float = 8.0) -> tuple[int, complex, complex]:
    """(agreeing matches, a, b) of target = a * query + b, places being column + row * i.

    a turns and scales. Every two matches at least ``apart`` from each other propose
    it (of more than ``PROPOSALS`` pairs, as many, evenly spread); all matches
    vote, and a query place (to a pixel) counts once.
    """
    zq, zt = q[:, 1] + 1j * q[:, 0], t[:, 1] + 1j * t[:, 0]
    i, j = np.nonzero(np.triu(np.abs(zq[:, None] - zq[None, :]) >= apart, 1))
    if not len(i):
        return 0, 1 + 0j, 0j
    if len(i) > PROPOSALS:
        spread = np.linspace(0, len(i) - 1, PROPOSALS).astype(int)
        i, j = i[spread], j[spread]
    a = (zt[j] - zt[i]) / (zq[j] - zq[i])
    good = (np.abs(a) >= 0.4) & (np.abs(a) <= 2.5)
    a, i = a[good], i[good]
    b = zt[i] - a * zq[i]
    pixel = np.unique(np.rint(q).astype(int), axis=0, return_inverse=True)[1].ravel()
    best = (0, 1 + 0j, 0j)
    step = max(1, 2_000_000 // len(zq))
    for at in range(0, len(a), step):
        near = np.abs(a[at : at + step, None] * zq + b[at : at + step, None] - zt) <= tolerance
        votes = near.sum(axis=1)
        for k in np.argsort(-votes, kind="stable")[:20].tolist():
            if votes[k] <= best[0]:
                break
            n = len(np.unique(pixel[near[k]]))
            if n > best[0]:
                best = (n, complex(a[at + k]), complex(b[at + k]))
    return best


def digest_of(data: bytes | None, image: np.ndarray | None, media: int) -> bytes:
    """Of a picture's pixels; of its bytes where it cannot be read, and of its id where there are none."""
    own = b"pixels %d %d " % image.shape + np.rint(image).astype("<u1").tobytes() if image is not None else b"bytes " + data if data else b"id %d" % media
    return hashlib.sha256(own).digest()


def descriptors(images: DataFrame, scales: tuple[float, ...] = (1.0,), turns: tuple[float, ...] = (0.0,), id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(media_id, digest, places, bits) for every picture; places are float32 (row, column), end to end like the bits.

    Pictures with the same pixels have the same digest; one that cannot be read
    has that of its bytes, or, where there are none, of its id, so it is alone.
    Both lists are empty where there are no corners. Null ids are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for media, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    image = decode(data)
                    p, b = describe(image, scales, turns) if image is not None else (np.empty(0), np.empty(0, np.uint8))
                    rows.append((media, digest_of(data, image, media), p.astype("<f4").tobytes(), b.tobytes()))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["media_id", "digest", "places", "bits"])

    rows = images.select(F.col(id_col).cast("long").alias("media_id"), F.col(image_col).cast("binary").alias("image")).where(F.col("media_id").isNotNull())
    return rows.mapInArrow(run, "media_id long, digest binary, places binary, bits binary")


def table_keys(found: DataFrame) -> DataFrame:
    """(key, media_id), distinct: a key for each descriptor and table, from the table's number and its band of bits.

    A band with fewer than ``PLAIN`` bits set, or unset, comes from a plain patch,
    tells nothing of a picture, and makes no key.
    """
    width = BITS // TABLES // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for data in batch.column(1).to_pylist():
                band = np.frombuffer(data, dtype=np.uint8).reshape(-1, TABLES, width)
                ones = np.bitwise_count(band).sum(axis=2)
                mixed = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), ones.shape)
                for at in range(0, width, 8):
                    part = np.zeros((*ones.shape, 8), dtype=np.uint8)
                    part[:, :, : min(8, width - at)] = band[:, :, at : at + 8]
                    mixed = (mixed ^ part.view("<u8")[:, :, 0]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = mixed ^ (mixed >> np.uint64(32))
                keys.append(np.unique(mixed[(ones >= PLAIN) & (ones <= 8 * width - PLAIN)]).view(np.int64))
            sizes = np.array([len(k) for k in keys], dtype=np.int64)
            media = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *keys])), pa.array(media)], names=["key", "media_id"])

    return found.select("media_id", "bits").mapInArrow(run, "key long, media_id long")


def copies(views: DataFrame, queries: DataFrame, found: DataFrame, max_bits: int = 67, votes: int = 2, least: int = 6) -> DataFrame:
    """(query_id, media_id, matches, scale, turn, dy, dx) for pairs of a query and another picture that are copies.

    ``views`` are the queries' descriptor rows at many scales and turns, which make
    keys; ``queries`` those at few, to be matched; ``found`` the classes'. Only (key, id) rows meet in the tables' join, never all pairs; a pair
    that shares ``votes`` keys gets its descriptors back by two joins on ids.
    """
    asked = table_keys(views).withColumnRenamed("media_id", "query_id")
    met = table_keys(found).join(asked, "key")
    pairs = met.groupBy("query_id", "media_id").agg(F.count_distinct("key").alias("votes")).where(F.col("votes") >= votes).select("query_id", "media_id")
    pairs = found.select("media_id", "places", "bits").join(hinted(pairs), "media_id").join(queries.select(F.col("media_id").alias("query_id"), F.col("places").alias("q_places"), F.col("bits").alias("q_bits")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, media, q_places, q_bits, places, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, t = (np.frombuffer(x, dtype="<f4").reshape(-1, 2).astype(np.float64) for x in (q_places, places))
                qb, tb = (np.frombuffer(x, dtype=np.uint8).reshape(-1, BITS // 8) for x in (q_bits, bits))
                # each of the picture's descriptors takes the query's nearest, of any scale and turn
                nearest, good = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=bool)
                for k, one in enumerate(tb):
                    apart = np.bitwise_count(qb ^ one).sum(axis=1, dtype=np.int64)
                    nearest[k] = apart.argmin()
                    good[k] = apart[nearest[k]] <= max_bits
                if good.sum() < least:
                    continue
                n, a, b = consensus(q[nearest[good]], t[good])
                if n >= least:
                    rows.append((query, media, n, abs(a), float(np.degrees(np.angle(a))), b.imag, b.real))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "media_id", "matches", "scale", "turn", "dy", "dx"])

    return pairs.select("query_id", "media_id", "q_places", "q_bits", "places", "bits").mapInArrow(run, "query_id long, media_id long, matches long, scale double, turn double, dy double, dx double")


def search(images: DataFrame, queries: DataFrame, id_col: str = "media_id", image_col: str = "image", **params) -> DataFrame:
    """(query_id, media_id, members, matches, scale, turn, dy, dx): classes of ``images`` that hold copies of each query.

    Pictures with the same pixels are one class: ``media_id`` is its smallest id
    and ``members`` its number of pictures, which are not expanded (the digests of
    ``descriptors`` tell them). A class with the query's very pixels has null
    matches; pictures without corners, or that cannot be read, can only be found
    so. Ids that repeat among queries are one query for each different picture,
    with that id; null ids are left out; other columns are not read.
    """
    described = durable(descriptors(images, id_col=id_col, image_col=image_col))
    group = described.groupBy("digest").agg(F.min("media_id").alias("media_id"), F.count("*").alias("members"))
    again = described.select("digest", "media_id").join(group.select("digest", F.col("media_id").alias("first")), "digest").where("media_id <> first").select("digest", "media_id").distinct()
    found = described.join(hinted(again), ["digest", "media_id"], "left_anti")
    rows = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(image_col).cast("binary").alias("image")).where(F.col("query_id").isNotNull())
    asked = durable(rows.withColumn("row", F.xxhash64("query_id", "image")).dropDuplicates(["row"]))
    plain = durable(descriptors(asked, MATCH_SCALES, id_col="row"))
    views = descriptors(asked, QUERY_SCALES, QUERY_TURNS, id_col="row")
    ids = plain.select(F.col("media_id").alias("row"), "digest").join(asked.select("row", "query_id", "image"), "row")
    # a query without any bytes has the digest of its own id
    ids = ids.select("row", "query_id", F.when(F.coalesce(F.length("image"), F.lit(0)) == 0, F.unhex(F.sha2(F.concat(F.lit("id "), F.col("query_id").cast("string")).cast("binary"), 256))).otherwise(F.col("digest")).alias("digest"))
    same = ids.join(group, "digest").select("query_id", "media_id", "members").distinct()
    near = copies(views, plain, found, **params).withColumnRenamed("query_id", "row").join(ids, "row").join(group.withColumnRenamed("digest", "own"), "media_id")
    near = near.where(F.col("own") != F.col("digest")).select("query_id", "media_id", "members", "matches", "scale", "turn", "dy", "dx").dropDuplicates(["query_id", "media_id"])
    return near.unionByName(same, allowMissingColumns=True)


def drawing(vector: np.ndarray, shapes: int = 28) -> np.ndarray:
    """A SIDE x SIDE picture of grained rectangles, all drawn from a vector's bytes."""
    rng = np.random.default_rng(zlib.crc32(vector.astype("<f4").tobytes()))
    picture = np.full((SIDE, SIDE), 120.0)
    for y, x, h, w, grey in rng.integers((0, 0, 5, 5, 0), (SIDE - 4, SIDE - 4, 22, 22, 230), (shapes, 5)):
        picture[y : y + h, x : x + w] = 12 + grey
    grain = resize(rng.normal(0, 1, (SIDE // 3, SIDE // 3)), SIDE, SIDE)
    return np.clip(0.55 * picture + 55 + 40 * grain, 0, 255)


def turned(picture: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre, bilinear; what lies outside is black."""
    height, width = picture.shape
    y, x = np.mgrid[0:height, 0:width] - np.array([(height - 1) / 2, (width - 1) / 2])[:, None, None]
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    yy, xx = (height - 1) / 2 + y * cos + x * sin, (width - 1) / 2 + x * cos - y * sin
    y0, x0 = np.clip(np.floor(yy).astype(int), 0, height - 2), np.clip(np.floor(xx).astype(int), 0, width - 2)
    fy, fx = np.clip(yy - y0, 0, 1), np.clip(xx - x0, 0, 1)
    value = (picture[y0, x0] * (1 - fx) + picture[y0, x0 + 1] * fx) * (1 - fy) + (picture[y0 + 1, x0] * (1 - fx) + picture[y0 + 1, x0 + 1] * fx) * fy
    return np.where((yy < 0) | (yy > height - 1) | (xx < 0) | (xx > width - 1), 0, value)


_K = np.arange(8)
_COSINES = np.cos(np.pi * (2 * _K[None] + 1) * _K[:, None] / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


def recompressed(picture: np.ndarray, step: float = 24) -> np.ndarray:
    """Cosine transforms of 8 x 8 blocks, rounded to ``step``, as lossy formats do it."""
    height, width = picture.shape[0] // 8 * 8, picture.shape[1] // 8 * 8
    blocks = picture[:height, :width].reshape(height // 8, 8, width // 8, 8).transpose(0, 2, 1, 3) - 128
    rounded = np.round(_COSINES @ blocks @ _COSINES.T / step) * step
    out = picture.copy()
    out[:height, :width] = (_COSINES.T @ rounded @ _COSINES + 128).transpose(0, 2, 1, 3).reshape(height, width)
    return out


EDITS = ("crop to half", "dim", "noise", "recompress", "smaller", "larger", "turn 90", "turn 15")


def edited(picture: np.ndarray, kind: int) -> np.ndarray:
    """The picture after one of the ``EDITS``."""
    side = len(picture)
    if kind == 0:
        cut = round(side * 0.5**0.5)
        out = picture[side - cut - 4 : side - 4, 6 : 6 + cut]
    elif kind == 1:
        out = picture * 0.6 + 30
    elif kind == 2:
        out = picture + np.random.default_rng(1).normal(0, 6, picture.shape)
    elif kind == 3:
        out = recompressed(picture)
    elif kind in (4, 5):
        size = round(side * (0.75 if kind == 4 else 1.25))
        out = resize(picture, size, size)
    else:
        out = np.rot90(picture) if kind == 6 else turned(picture, 15)
    return np.clip(np.rint(out), 0, 255)


def media(embeddings: DataFrame, edit: bool = False) -> DataFrame:
    """(media_id, image): each embedding's drawing, or an edited copy of it; the edit goes by vec_id / 20 modulo 8.

    The tables hold no pictures, so they are drawn from the vectors. Null vectors,
    and those of fewer than 64 values, give an empty image; null ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                images = []
                for vec_id, vector in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    good = vector is not None and len(vector) >= 64 and None not in vector
                    picture = drawing(np.array(vector, dtype=np.float32)) if good else None
                    if good and edit:
                        picture = edited(np.rint(picture), (vec_id or 0) // 20 % len(EDITS))
                    images.append(to_png(np.rint(picture)) if good else b"")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], names=["media_id", "image"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "media_id long, image binary")


def op10_image_copies(spark, sf_dir: str) -> DataFrame:
    """Edited copies of the pictures whose vec_id is divisible by 20, searched among the pictures of all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(media(vectors), media(vectors.where(F.col("vec_id") % 20 == 0), edit=True))
