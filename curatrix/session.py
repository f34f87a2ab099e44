"""Session settings, and shipping the package to workers that cannot import it."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings in ``conf`` win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
    } | conf
    spark = SparkSession.builder.master(master).config(map=settings).getOrCreate()
    ship(spark)
    return spark


#: Rows hold whole texts, so the batches that go to Python are kept small; a session's own values win.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine find the package; a cluster gets it by --py-files or an image."""
    for name, (usual, small) in BATCHES.items():
        if spark.conf.get(name, None) == usual:
            spark.conf.set(name, small)
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def tasks_for(spark: SparkSession) -> int:
    """Tasks for steps that cost much more than reading: two a core, and no fewer than a shuffle has."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to ``tasks_for`` tasks by ``keys``, whatever the files are: a small file of keys is one task, and so is all that is made of it."""
    return frame.repartition(tasks_for(frame.sparkSession), *keys)


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of a column (a row at least); free memory goes back at the end, where the C library can do that."""
    for batch in batches:
        step = max(1, most * batch.num_rows // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one is made only in local mode."""
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at


def durable(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and cut its lineage there."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
