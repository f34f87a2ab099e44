"""Pictures as pixels (O-11, O-13, O-14, O-83, O-136): decoding, resampling, hashes, padding and sheets.

Pixels are numpy arrays (height, width, 3) of bytes. Tasks decode the pictures of one
Arrow batch after the other, so a task holds one batch and one picture.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.session import spread

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First place and step of the seven passes of an interlaced PNG: (row, column, row step, column step).
_PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """An RGB picture as PNG."""
    height, width = pixels.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), dtype=np.uint8), pixels.reshape(height, -1)], axis=1)
    return png_of(width, height, 8, 2, lines.tobytes(), level=level)


def png_of(width: int, height: int, depth: int, kind: int, lines: bytes, palette: bytes | None = None, interlaced: bool = False, level: int = 6) -> bytes:
    """A PNG file around filtered lines."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, int(interlaced)))
    return _SIGNATURE + head + (chunk(b"PLTE", palette) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(lines, level)) + chunk(b"IEND", b"")


def _unfiltered(data: bytes, lines: int, stride: int, step: int) -> np.ndarray:
    """Lines of ``stride`` bytes, their filters undone; ``step`` is the distance to the pixel on the left, in bytes."""
    raw = np.frombuffer(data, dtype=np.uint8, count=lines * (stride + 1)).reshape(lines, stride + 1)
    if not raw[:, 0].any():
        return raw[:, 1:]
    out = np.zeros((lines + 1, stride), dtype=np.uint8)
    for k in range(lines):
        kind, line, above = raw[k, 0], raw[k, 1:], out[k]
        if kind == 0:
            out[k + 1] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, dtype=np.uint8)
            padded[:stride] = line
            out[k + 1] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            out[k + 1] = line + above
        elif kind in (3, 4):
            left, up, now = bytearray(stride + step), above.tolist(), line.tolist()
            for i, v in enumerate(now):
                a, b = left[i], up[i]
                if kind == 3:
                    left[i + step] = v + (a + b >> 1) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    left[i + step] = v + (a if p <= q and p <= r else b if q <= r else c) & 255
            out[k + 1] = np.frombuffer(left, dtype=np.uint8)[step:]
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:]


def _samples(lines: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """(lines, width, samples) of unpacked values; 16 bits keep their high byte."""
    if depth == 16:
        return lines.reshape(len(lines), width, samples, 2)[..., 0]
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        lines = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : width * samples]
    return lines.reshape(len(lines), width, samples)


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG of any colour type and depth, interlaced or not; alpha is left out. A broken chunk or a short body is an error."""
    body, palette, head, at = b"", None, None, 8
    while True:
        if at + 12 > len(data):
            raise ValueError("truncated file")
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 4 : at + 8 + size]
        if len(part) < size + 4 or zlib.crc32(part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"broken chunk {name.decode('latin-1')}")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part[4:17])
        elif name == b"PLTE":
            palette = np.frombuffer(part[4:], dtype=np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += part[4:]
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None or not head[0] or not head[1] or head[3] not in _SAMPLES:
        raise ValueError("no usable header")
    width, height, depth, kind, _, _, interlaced = head
    if kind == 3 and palette is None:
        raise ValueError("no palette")
    samples, raw, used = _SAMPLES[kind], zlib.decompress(body), 0
    values = np.zeros((height, width, samples), dtype=np.uint8)
    for row, column, down, across in _PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - column) // across), -(-(height - row) // down)
        if w > 0 and h > 0:
            stride = -(-w * samples * depth // 8)
            lines = _unfiltered(raw[used : used + h * (stride + 1)], h, stride, max(1, samples * depth // 8))
            values[row::down, column::across] = _samples(lines, w, depth, samples)
            used += h * (stride + 1)
    if kind == 3:
        if values.max() >= len(palette):
            raise ValueError("colour beyond the palette")
        return palette[values[..., 0]]
    if depth < 8:
        values = values * (255 // ((1 << depth) - 1))
    return values[..., :3] if samples > 2 else np.repeat(values[..., :1], 3, axis=2)


def decode(data: bytes | None) -> np.ndarray:
    """O-11: RGB pixels of a PNG, a binary PGM or PPM, or of anything Pillow reads where it is installed; else ValueError."""
    if not data:
        raise ValueError("empty file")
    if data[:8] == _SIGNATURE:
        return decode_png(data)
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        width, height, most = fields
        samples = 1 if data[:2] == b"P5" else 3
        if most != 255 or len(data) < at + 1 + width * height * samples:
            raise ValueError("truncated file" if most == 255 else "unsupported depth")
        values = np.frombuffer(data, dtype=np.uint8, count=width * height * samples, offset=at + 1).reshape(height, width, samples)
        return np.repeat(values, 3, axis=2) if samples == 1 else values
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("cannot identify image file") from None
    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("RGB"))


_GREY = np.array([19595.0, 38470.0, 7471.0])


def luminance(pixels: np.ndarray) -> np.ndarray:
    """Grey of RGB pixels: 0.299, 0.587 and 0.114 as 16-bit fractions, rounded."""
    return ((pixels.astype(np.float64) @ _GREY).astype(np.int64) + 0x8000) >> 16  # whole numbers under 2^53 are exact


@lru_cache(maxsize=256)
def lanczos(size: int, out: int, lobes: int = 3) -> np.ndarray:
    """(out, size) weights of an antialiased resampling by the Lanczos window, as 22-bit fractions.

    The window is as wide as ``lobes`` pixels of the coarser grid; weights are normalised before they are rounded.
    """
    scale = size / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    low = np.maximum((centre - lobes * wide + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + lobes * wide + 0.5).astype(np.int64), size)
    x = np.arange(size)
    at = (x[None, :] - centre[:, None] + 0.5) / wide
    weight = np.where((np.abs(at) < lobes) & (x[None, :] >= low[:, None]) & (x[None, :] < high[:, None]), np.sinc(at) * np.sinc(at / lobes), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.where(weight < 0, np.ceil(weight * (1 << 22) - 0.5), np.floor(weight * (1 << 22) + 0.5))


def resized(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """Grey or colour values resampled to (height, width), across and then down, each rounded to bytes."""
    half = 1 << 21

    def pass_(weights: np.ndarray, v: np.ndarray) -> np.ndarray:  # along the first axis
        sums = weights @ v.reshape(len(v), -1)  # whole numbers under 2^53, so doubles are exact
        return ((sums.reshape(-1, *v.shape[1:]).astype(np.int64) + half) >> 22).clip(0, 255).astype(np.float64)

    v = values.astype(np.float64)
    if v.shape[1] != width:
        v = np.swapaxes(pass_(lanczos(v.shape[1], width), np.swapaxes(v, 0, 1)), 0, 1)
    if v.shape[0] != height:
        v = pass_(lanczos(v.shape[0], height), v)
    return v.astype(np.int64)


def difference_hash(pixels: np.ndarray, rows: int = 8, columns: int = 8) -> int:
    """O-83: a bit for each pair of neighbours of the picture at 9 x 8, set where the left one is brighter; the first pair is the highest bit of a signed long."""
    grid = resized(luminance(pixels), columns + 1, rows)
    bits = np.packbits(grid[:, :-1] > grid[:, 1:])
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def picture_facts(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """O-11, O-83: (id, width, height, dhash, error) of every picture; one that cannot be decoded whole has an error and nothing else.

    Null and empty contents are errors; rows may repeat.
    """
    kind = dict(files.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1):
                try:
                    pixels = decode(None if not data.is_valid else bytes(data.as_buffer()))
                    rows.append((pixels.shape[1], pixels.shape[0], difference_hash(pixels), None))
                except Exception as error:  # whatever a decoder raises is the row's result
                    rows.append((None, None, None, f"{type(error).__name__}: {error}"))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "width", "height", "dhash", "error"])

    return files.select(id_col, F.col(content).alias("_content")).mapInArrow(run, f"`{id_col}` {kind}, width int, height int, dhash long, error string")


@lru_cache(maxsize=256)
def _edges(size: int, border: int) -> np.ndarray:
    """Places on an axis with its ends repeated."""
    return np.arange(-border, size + border).clip(0, size - 1)


def edge_padded(pixels: np.ndarray, border: int) -> np.ndarray:
    """O-136: the picture with its edge pixels repeated ``border`` times on every side."""
    height, width = pixels.shape[:2]
    return pixels[_edges(height, border)[:, None], _edges(width, border)]


def fitted(pixels: np.ndarray, side: int, ground: int = 0) -> np.ndarray:
    """O-13: the picture resampled to fit into a square, in its middle."""
    height, width = pixels.shape[:2]
    scale = side / max(height, width)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    square = np.full((side, side, 3), ground, dtype=np.uint8)
    top, left = (side - h) // 2, (side - w) // 2
    square[top : top + h, left : left + w] = resized(pixels, w, h)
    return square


def sheet(tiles: Sequence[np.ndarray], columns: int = 7, ground: int = 255) -> np.ndarray:
    """O-14: tiles of one size in rows of ``columns``, first to last; empty places show the ground."""
    height, width = tiles[0].shape[:2]
    rows = -(-len(tiles) // columns)
    out = np.full((rows * height, columns * width, 3), ground, dtype=np.uint8)
    for k, tile in enumerate(tiles):
        row, column = divmod(k, columns)
        out[row * height : (row + 1) * height, column * width : (column + 1) * width] = tile
    return out


def rewritten(files: DataFrame, change, schema: str, content: str = "content") -> DataFrame:
    """O-13, O-136: ``change`` (a function of pixels) over every picture; the other columns of ``schema`` stay. Undecodable pictures fail the job."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_png(change(decode(bytes(data.as_buffer())))) for data in batch.column(batch.schema.get_field_index(content))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if n == content else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return files.select(*names).mapInArrow(run, schema)


def sheets(tiles: DataFrame, key: str, order: str, side: int, columns: int = 7, most: int = 1000, content: str = "content") -> DataFrame:
    """O-14: (key, page, tiles, content): a sheet of each key's pictures in their order, ``most`` on a page, so that no task holds more.

    A key's pages are made apart from each other; ``order`` is a long from 0 without gaps.
    """
    kind = dict(tiles.dtypes)[key]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_order")
        pixels = [fitted(decode(bytes(d.as_buffer())), side) for d in group["_content"]]
        return pa.table({key: group[key][:1], "page": group["_page"][:1], "tiles": pa.array([len(pixels)], pa.int32()), "content": pa.array([encode_png(sheet(pixels, columns))], pa.binary())})

    pages = tiles.select(key, F.floor(F.col(order) / most).alias("_page"), F.col(order).alias("_order"), F.col(content).alias("_content"))
    return spread(pages, key, "_page").groupBy(key, "_page").applyInArrow(run, f"`{key}` {kind}, page long, tiles int, content binary")
