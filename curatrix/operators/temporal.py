"""Stream semantics over stored events (O-104, O-110, O-111, O-113..O-116).

The functional forms here use windows and group-wise folds; ``machines`` has the
same rules as step functions, which the streaming twins share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from curatrix.operators import segments
from curatrix.streaming import machines


def monotone_clock(df: DataFrame, key: str, t: Column, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """O-104: ``clock``: the least integer at or above t that is above the one before it. ``ranges``: see ``segments``; None counts the keys' rows."""
    if (ranges := ranges or segments.ranges_for(df, key)) is not None:
        return segments.monotone_clock(df, key, t, order, ranges)
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w)
    rows = df.withColumn("_n", n).withColumn("_c", F.ceil(t) - F.col("_n"))
    running = F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("clock", (running + F.col("_n")).cast("long")).drop("_n", "_c")


def frame_rate(df: DataFrame, key: str, ts: Column, span: str = "1 second") -> DataFrame:
    """O-110: frames in each span of event time, as a rate."""
    return df.groupBy(key, F.window(ts, span).alias("w")).agg(F.count("*").alias("frames")).select(key, F.col("w.start").alias("start"), "frames")


def frame_meter(df: DataFrame, key: str, ms: Column, latency: Column, span_ms: int = 1000) -> DataFrame:
    """O-110: adds fps (of the last closed window), frames and closed (at rows that close a window) and latency_ms.

    Windows follow each other: each begins with the frame that closed the one before. Times ascend within a key.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = df.withColumns({"_ms": ms, "latency_ms": latency.cast("double")})
    return folded(rows, key, ["_ms"], machines.meter(span_ms, "_ms"), f"{kept}, latency_ms double, fps double, frames long, closed boolean")


def observed(stream: DataFrame, latency: str, name: object = "meter") -> DataFrame:
    """O-110: a stream, or a batch, whose every (micro-)batch reports its frames and latency under ``name``: ``query.lastProgress.observedMetrics``."""
    return stream.observe(name, F.count(F.lit(1)).alias("frames"), F.avg(latency).alias("latency_ms"), F.max(latency).alias("worst_ms"))


def sliding_majority(df: DataFrame, key: str, ms: Column, label: Column, confidence: Column, window_ms: int = 420, least: int = 5, ratio: float = 0.64, ranges: int | None = None) -> DataFrame:
    """O-113: adds stable_label and stable_confidence.

    The window reaches back ``window_ms``, its edge included. The commonest label
    wins, the first seen on a tie. Too few samples give UNKNOWN with 0; UNKNOWN
    itself, or too small a share, gives UNKNOWN with the winner's mean. Times have
    to be unique for a key. Running counts of each label are taken once and
    subtracted, so a busy key costs its rows times its labels. A key with more rows
    than suit one task is cut into ``ranges``, each of which has the rows before it that reach into its windows.
    """
    rows = df.withColumns({"_ms": ms, "_label": label, "_confidence": F.coalesce(confidence.cast("double"), F.lit(0.0))})
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    machine = machines.majority(window_ms, least, ratio, "_ms", "_label", "_confidence")
    if (ranges := ranges or segments.ranges_for(df, key)) is not None:
        parts = segments.with_lead_in(rows, key, F.col("_ms"), window_ms, ranges)
        found = folded(parts, "_segment", ["_ms"], machine, f"{kept}, _own boolean, stable_label string, stable_confidence double")
        return found.where("_own").drop("_own")
    return folded(rows, key, ["_ms"], machine, f"{kept}, stable_label string, stable_confidence double")


def commit_latch(df: DataFrame, key: str, ms: Column, label: Column, release_ms: int = 300, ranges: int | None = None) -> DataFrame:
    """O-114: rows at which a label is committed: it is not the locked one.

    A run of UNKNOWN rows that spans ``release_ms`` unlocks, measured at its rows.
    Gaps and islands: each known row carries the run of UNKNOWN rows before it. ``ranges`` as for the clock.
    """
    if (ranges := ranges or segments.ranges_for(df, key)) is not None:
        return segments.commit_latch(df, key, ms, label, release_ms, ranges)
    w = Window.partitionBy(key).orderBy("_ms")
    known = F.col("_l") != "UNKNOWN"
    rows = df.withColumn("_ms", ms).withColumn("_l", label)
    rows = rows.withColumn("_island", F.count_if(known).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy(key, "_island")
    rows = rows.withColumn("_span", F.max(F.when(~known, F.col("_ms"))).over(run) - F.min(F.when(~known, F.col("_ms"))).over(run))
    rows = rows.where(known).withColumn("_before", F.lag("_l").over(w)).withColumn("_gap", F.lag("_span").over(w))
    commit = F.col("_before").isNull() | (F.col("_before") != F.col("_l")) | (F.coalesce("_gap", F.lit(-1)) >= release_ms)
    return rows.where(commit).drop("_ms", "_l", "_island", "_span", "_before", "_gap")


def transcript_tail(df: DataFrame, key: str, order: Sequence[str], label: str, keep: int = 16) -> DataFrame:
    """O-115: the last labels of each key, oldest first, joined by spaces."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    rows = df.withColumn("_r", last).where(F.col("_r") <= keep)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(label).alias("l")))), lambda s: s["l"]), " ").alias("transcript"))


def folded(df: DataFrame, key: str, order: Sequence[str], machine: machines.Machine, schema: str) -> DataFrame:
    """Runs a step machine over each key's rows in order; ``schema`` is the result's.

    For the rules that depend on their own last results (O-111, O-113, O-116).
    Partitions are sorted by key and order and folded batch by batch as arrays,
    the state of the open key being carried on; one key's rows pass through one
    task, as they would through one device, but never lie in memory together.
    """
    fields = StructType.fromDDL(schema)
    given = [n for n in fields.fieldNames() if n in df.columns]
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            owner = np.array(batch.column(names.index(key)).to_pylist(), dtype=object)
            cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])).tolist()
            needed = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names) if not pa.types.is_nested(batch.schema.field(k).type)}
            places, results = [], []
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if not begun or owner[a] != open_key:
                    open_key, state, begun = owner[a], machine.start(), True
                state, at, out = machine.run(state, {n: c[a:b] for n, c in needed.items()})
                places.append(at + a)
                results.append(out)
            rows = batch.take(pa.array(np.concatenate(places)))
            columns = []
            for field in target:
                if field.name in given:
                    columns.append(rows.column(names.index(field.name)).cast(field.type))
                else:
                    columns.append(pa.array(np.concatenate([r[field.name] for r in results if field.name in r]).tolist() if rows.num_rows else [], field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, fields)
