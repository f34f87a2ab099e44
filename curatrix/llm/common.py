"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that separate words; every other byte is part of one.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one is made only in local mode."""
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at


def durable(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and cut its lineage there."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def hinted(frame: DataFrame, most: int = 200_000) -> DataFrame:
    """A frame of narrow rows, written and counted: with a broadcast hint at ``most`` rows or fewer, without one beyond."""
    kept = durable(frame)
    return F.broadcast(kept) if kept.count() <= most else kept


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that ``frame`` does not have yet, whatever the case of its names."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def id_crc(name: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def give_back() -> None:
    """Lets the allocator return free memory, so a worker that waits for its next task is small. Elsewhere than on glibc nothing happens."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of the text column (one row at least); free memory goes back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // batch.num_rows)
        step = max(1, max_bytes // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def hash_sample(ids: DataFrame, most: int, column: str = "_id") -> DataFrame:
    """At most ``most`` of the distinct ``ids``: those whose hash is under a threshold that counts find.

    No rows are sorted or gathered; the threshold depends on the ids alone, so
    the same ids give the same sample.
    """
    n, share, kept = ids.count(), 1.0, ids
    while n > most:
        share *= 0.95 * most / n
        kept = ids.where(F.pmod(F.xxhash64(column), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
        n = kept.count()
    return kept


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sample`` (its ``_id`` and other columns; bounded rows) with one text for each id.

    An id that repeats in ``docs`` takes its smallest text, so the rows stay
    within the sample's bound. Ids without a document are left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("text"))
    found = texts.join(F.broadcast(sample.select("_id").distinct()), "_id", "left_semi").groupBy("_id").agg(F.min("text").alias("text"))
    return found.join(F.broadcast(sample), "_id")
