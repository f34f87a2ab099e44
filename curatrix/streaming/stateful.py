"""Structured Streaming twins of the temporal operators (O-17, O-111, O-113, O-114, O-116..O-119).

A machine's state is kept for each key (session and mode), so changing either is
a reset. Rows of a micro-batch are put in order of time before they are stepped
through. Keys that stay silent beyond the timeout past the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curatrix.streaming.machines import Machine


def read_frames(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """O-17: a stream of frame events from a folder of Parquet files; ``files_per_batch`` holds it back."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _tuples(value):
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


def run_machine(stream: DataFrame, keys: Sequence[str], time: str, machine: Machine, schema: str, lateness: str = "1 hour", idle_ms: int = 86_400_000, order: str | None = None) -> DataFrame:
    """O-111..O-118: steps each key's rows through the machine; ``schema`` is the result's.

    ``time`` is the event time column. The watermark (``lateness``) bounds how
    late rows may come in another batch; earlier ones are dropped. State is JSON
    text, and is gone ``idle_ms`` after the key's last row.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = _tuples(json.loads(state.get[0])) if state.exists else machine.start()
        parts = list(parts)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        place = rows[order or time].to_numpy().argsort(kind="stable")
        columns = {c: rows[c].to_numpy()[place] for c in rows.columns}
        now, at, found = machine.run(now, {c: v for c, v in columns.items() if c != time})
        state.update((json.dumps(now, default=lambda x: x.item()),))
        last = int(columns[time].max().astype("datetime64[ms]").astype("int64"))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({n: found[n] if n in found else columns[n][at] if n in columns else np.full(len(at), None) for n in names})

    grouped = stream.withWatermark(time, lateness).groupBy(*keys)
    return grouped.applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(result: DataFrame, out: str, checkpoint: str) -> None:
    """O-119: processes what has come since the last call and stops; a call after a failure goes on where it left off."""
    query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def pending(items: DataFrame, done: DataFrame, key: str, most: int | None = None, force: bool = False) -> DataFrame:
    """O-119 in batch: items whose key is not done yet, in key order up to ``most``; all of them with ``force``."""
    left = items if force else items.join(done.select(key), key, "left_anti")
    return left if most is None else left.orderBy(key).limit(most)
