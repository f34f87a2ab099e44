"""Readers and writers (O-01..O-12, O-15, O-16, O-18)."""

from __future__ import annotations

import io
import json
import os
import struct
import tempfile
import time
import zlib
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix import schemas
from curatrix.functions.text import extension, is_image


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """O-01, O-02: (path, length, extension, is_image[, content]) of all files below root; a missing root is an error.

    Without ``content`` the files themselves are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    return files.select("path", F.col("length").cast("long").alias("length"), extension(path).alias("extension"), is_image(path).alias("is_image"), *(["content"] if content else []))


def image_facts(data: bytes | None) -> tuple[int, int, str]:
    """(width, height, mode) of PNG (all of whose chunks are checked), JPEG headers, or of anything Pillow verifies; else ValueError."""
    if not data:
        raise ValueError("empty file")
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 33:
        width, height, _, kind = struct.unpack(">IIBB", data[16:26])
        body, at, ended = zlib.decompressobj(), 8, False
        while at + 12 <= len(data) and not ended:
            size, name = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 4 : at + 8 + size]
            if len(part) < size + 4 or zlib.crc32(part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
                raise ValueError(f"broken chunk {name.decode('latin-1')}")
            if name == b"IDAT":
                body.decompress(part[4:])
            ended = name == b"IEND"
            at += 12 + size
        if not ended or not body.eof:
            raise ValueError("truncated file")
        return width, height, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind, "?")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(data[at + 9], "?")
            at += 2 + size
        raise ValueError("no frame header")
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("cannot identify image file") from None
    with Image.open(io.BytesIO(data)) as image:
        image.verify()
        return *image.size, image.mode


def inspect_images(files: DataFrame) -> DataFrame:
    """O-03, O-04, O-11: (path, length, dimensions, mode, sha256, error). Errors never fail the job; such rows have no digest."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part["content"]:
                try:
                    width, height, mode = image_facts(data)
                    rows.append((f"{width}x{height}", mode, None))
                except Exception as error:  # whatever a decoder raises is the row's result
                    rows.append((None, None, f"{type(error).__name__}: {error}"))
            found = pd.DataFrame(rows, columns=["dimensions", "mode", "error"], index=part.index)
            yield pd.concat([part[["path", "length", "digest"]], found], axis=1)

    hashed = files.select("path", "length", "content", F.sha2("content", 256).alias("digest"))
    seen = hashed.mapInPandas(run, "path string, length long, digest string, dimensions string, mode string, error string")
    return seen.select("path", "length", "dimensions", "mode", F.when(F.col("error").isNull(), F.col("digest")).alias("sha256"), "error")


def render_png(pixels: np.ndarray, side: int = 640) -> bytes:
    """O-13: an RGB picture (height, width, 3) fitted into a square on black, as PNG bytes."""
    height, width = pixels.shape[:2]
    scale = side / max(height, width)
    rows = np.minimum((np.arange(max(1, round(height * scale))) / scale).astype(int), height - 1)
    columns = np.minimum((np.arange(max(1, round(width * scale))) / scale).astype(int), width - 1)
    square = np.zeros((side, side, 3), dtype=np.uint8)
    top, left = (side - len(rows)) // 2, (side - len(columns)) // 2
    square[top : top + len(rows), left : left + len(columns)] = pixels[rows][:, columns]
    lines = np.concatenate([np.zeros((side, 1), dtype=np.uint8), square.reshape(side, -1)], axis=1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def write_files(df: DataFrame, root: str) -> DataFrame:
    """O-13: writes each row's ``content`` to ``root``/``name``, a folder that all executors can open; (name, length) of what was written.

    A file is written beside its place and renamed, so a task that is run again
    leaves whole files only. Call an action once; every run writes.
    """

    base = root.removeprefix("file://").removeprefix("file:")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                target = Path(base) / name
                target.parent.mkdir(parents=True, exist_ok=True)
                handle, beside = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
                with os.fdopen(handle, "wb") as out:
                    out.write(content)
                os.replace(beside, target)
            yield pd.DataFrame({"name": part["name"], "length": part["content"].map(len)})

    return df.select("name", "content").mapInPandas(run, "name string, length long")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.MANIFEST) -> DataFrame:
    """O-05: CSV with a header and an explicit schema; a row that does not fit is an error."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)


def with_original_label(df: DataFrame) -> DataFrame:
    """The older column when it is there and filled, else ``label``."""
    return df.withColumn("original_label", F.coalesce(F.nullif("original_label", F.lit("")), "label")) if "original_label" in df.columns else df.withColumn("original_label", F.col("label"))


def write_csv(df: DataFrame, path: str, schema: T.StructType = schemas.MANIFEST) -> None:
    """O-06: the schema's columns in its order, with a header; other columns are left out. The commit protocol publishes at once."""
    df.select(*schema.fieldNames()).write.mode("overwrite").option("header", "true").csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """O-07: one document for each file; fields that a file lacks are null, so older schemas read too."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json_atomic(value: object, path: str, spark: SparkSession | None = None) -> None:
    """O-08, O-15: control files from the driver; written beside the target and renamed. With ``spark`` the path may be in any store that Spark knows."""
    if spark is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs
        target, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid4().hex}.tmp")
        store = target.getFileSystem(spark._jsc.hadoopConfiguration())
        out = store.create(beside, True)
        out.write(bytearray((json.dumps(value, indent=2) + "\n").encode()))
        out.close()
        store.delete(target, False)
        if not store.rename(beside, target):
            raise OSError(f"cannot publish {path}")
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2)
        out.write("\n")
    os.replace(name, target)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _chunk_facts(store: DataFrame, width: int) -> DataFrame:
    """(chunk_index, rows, whole, low_key, high_key, digest) of every chunk: one aggregate; the digest does not depend on the rows' order."""
    marks = F.xxhash64(*(f.name for f in schemas.STORE.fields if f.name != "chunk_index"))
    return store.groupBy("chunk_index").agg(F.count("*").alias("rows"), F.count_if(F.size("features") == width).alias("whole"), F.min("generation_key").alias("low_key"), F.max("generation_key").alias("high_key"), F.bit_xor(marks).alias("digest"), F.sum(F.shiftright(marks, 16)).alias("total"))


def write_store(df: DataFrame, path: str, width: int = 132) -> None:
    """O-09: the landmark store, a folder for each chunk; rewriting a chunk replaces that chunk alone.

    A commit log beside the chunks takes their rows and digests, from what was written, once the chunks stand.
    """
    spark = df.sparkSession
    df.select(*schemas.STORE.fieldNames()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_index").parquet(path)
    written = df.select("chunk_index").distinct()
    facts = _chunk_facts(read_store(spark, path).join(F.broadcast(written), "chunk_index", "left_semi"), width)
    facts.withColumn("version", F.lit(time.time_ns())).write.mode("append").parquet(f"{path}/_commits")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STORE).parquet(path)


def valid_chunks(spark: SparkSession, path: str, expected: DataFrame, width: int = 132) -> DataFrame:
    """O-10: (chunk_index, valid) for every row of ``expected`` (chunk_index, key, count), all chunks in one pass.

    Valid: as many rows as expected, whole vectors, this key throughout, and what the last commit of the chunk logged. Files that
    cannot be read, or are not there, count as no rows, so their chunks are invalid; other faults are errors.
    """
    if not _exists(spark, f"{path}/_commits"):
        return expected.select("chunk_index", F.lit(False).alias("valid"))
    lenient = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    have = _chunk_facts(spark.read.options(**lenient).schema(schemas.STORE).parquet(path), width)
    facts = [c for c in have.columns if c != "chunk_index"]
    log = spark.read.options(**lenient).parquet(f"{path}/_commits").groupBy("chunk_index").agg(F.max_by(F.struct(*facts), "version").alias("logged"))
    met = expected.select("chunk_index", "key", "count").join(have, "chunk_index", "left").join(log, "chunk_index", "left")
    good = (F.col("rows") == F.col("count")) & (F.col("whole") == F.col("count")) & (F.col("low_key") == F.col("key")) & (F.col("high_key") == F.col("key")) & F.col("logged").eqNullSafe(F.struct(*facts))
    return met.select("chunk_index", F.coalesce(good, F.lit(False)).alias("valid"))


def valid_chunk(spark: SparkSession, path: str, index: int, key: str, count: int, width: int = 132) -> bool:
    """O-10 of one chunk."""
    expected = spark.createDataFrame([(index, key, count)], "chunk_index int, key string, count long")
    return valid_chunks(spark, path, expected, width).first()["valid"]


def parse_annotations(text: Column) -> Column:
    """O-12: annotation struct of an XML text; broken XML fills ``_corrupt_record``."""
    return F.from_xml(text, schemas.ANNOTATION, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})


def load_model(spark: SparkSession, path: str) -> dict:
    """O-16: a model file as a dict, through Spark's reader, so any store will do."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def registered(rows: DataFrame) -> DataFrame:
    """O-18: sources with optional fields under either name (doi or dataset_doi, page_url or repository_url) as one table; columns that are lacking are null."""
    have = {c.lower() for c in rows.columns}
    field = lambda *names: F.coalesce(*(F.col(n) if n in have else F.lit(None).cast("string") for n in names), F.lit(None).cast("string")).alias(names[0])
    return rows.select(*map(field, ("id", "name", "language", "version")), field("doi", "dataset_doi"), field("page_url", "repository_url"))


def source_registry(spark: SparkSession, path: str) -> DataFrame:
    """O-18: the registry of JSON files of sources, a file or line each."""
    return registered(read_json(spark, path, T.StructType.fromDDL("id string, name string, language string, version string, doi string, dataset_doi string, page_url string, repository_url string")))
