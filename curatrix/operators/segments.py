"""Ordered rules over keys of any size (O-104, O-113, O-114): one key's rows over many tasks.

Rows are cut into ranges of (key, time), so a busy key spreads over many of them. Each
range is summed up for the keys it holds, the summaries of a key (no more than there are ranges) are scanned,
and every range goes on from what stands before it, on its own. Results are those of the
same rules over whole keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.session import durable, tasks_for

#: Rows of one key that one task takes; a larger key is cut into ranges.
KEY_ROWS = 500_000


def ranges_for(df: DataFrame, key: str, most: int = KEY_ROWS) -> int | None:
    """The number of ranges that a frame needs, or None where every key suits one task."""
    found = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (found[0] or 0) <= most:
        return None
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found[1] // most))


def cut(df: DataFrame, key: str, order: Sequence[str], ranges: int) -> DataFrame:
    """The rows with ``_range``, which ascends in the order of (key, order); written, so that places stay as they are."""
    return durable(df.repartitionByRange(ranges, key, *order).withColumn("_range", F.spark_partition_id()))


def _before(key: str):
    return Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """``name``: a row's place within its key, from 0. Ranges number their own rows, and counts of the ranges before are added, so no task has a whole key."""
    parts = cut(rows, key, order, tasks_for(rows.sparkSession))
    counts = durable(parts.groupBy(key, "_range").agg(F.count("*").alias("_rows")))
    offset = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(_before(key)), F.lit(0)).alias("_at"))
    local = parts.withColumn(name, F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1)
    met = local.join(F.broadcast(offset), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return met.withColumn(name, F.col(name) + F.col("_at")).drop("_range", "_key", "_r", "_at")


def monotone_clock(rows: DataFrame, key: str, t: Column, order: Sequence[str], ranges: int) -> DataFrame:
    """O-104: within a key, a row's clock is its number plus the greatest of (ceiling of t - number) so far; numbers and greatest values add up over ranges."""
    parts = cut(rows.withColumn("_c", F.ceil(t)), key, order, ranges)
    w = Window.partitionBy(key, "_range").orderBy(*order)
    local = parts.withColumn("_n", F.row_number().over(w)).withColumn("_top", F.col("_c") - F.col("_n"))
    sums = durable(local.groupBy(key, "_range").agg(F.count("*").alias("_rows"), F.max("_top").alias("_most")))
    offset = sums.withColumn("_at", F.coalesce(F.sum("_rows").over(_before(key)), F.lit(0)))
    offset = offset.withColumn("_high", F.max(F.col("_most") - F.col("_at")).over(_before(key))).select(F.col(key).alias("_key"), F.col("_range").alias("_r"), "_at", "_high")
    running = F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = local.withColumn("_run", running).join(offset, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    clock = F.greatest(F.col("_run") - F.col("_at"), "_high") + F.col("_at") + F.col("_n")
    return met.withColumn("clock", clock.cast("long")).drop("_c", "_n", "_top", "_run", "_range", "_key", "_r", "_at", "_high")


def commit_latch(rows: DataFrame, key: str, ms: Column, label: Column, release_ms: int, ranges: int) -> DataFrame:
    """O-114: a range hands on its last known label and the run of UNKNOWN rows that is open at its end."""
    parts = cut(rows.withColumns({"_ms": ms, "_l": label}), key, ["_ms"], ranges)
    known = F.col("_l") != "UNKNOWN"
    w = Window.partitionBy(key, "_range").orderBy("_ms")
    parts = parts.withColumn("_island", F.count_if(known).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the last island's UNKNOWN rows are open at the range's end; a range without a known row has island 0 alone
    islands = parts.groupBy(key, "_range", "_island").agg(F.max(F.when(known, F.col("_l"))).alias("_named"), F.min(F.when(~known, F.col("_ms"))).alias("_from"), F.max(F.when(~known, F.col("_ms"))).alias("_to"))
    sums = durable(islands.groupBy(key, "_range").agg(F.max_by(F.struct("_named", "_from", "_to", "_island"), "_island").alias("_last")))
    has = F.col("_last._island") > 0
    span = sums.withColumn("_group", F.count_if(has).over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # what stands open before a range: since the last range with a known label, that one's tail included
    here = Window.partitionBy(key, "_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = span.withColumns({"_open_from": F.min("_last._from").over(here), "_open_to": F.max("_last._to").over(here), "_held": F.max(F.when(has, F.col("_last._named"))).over(here)})
    along = Window.partitionBy(key).orderBy("_range")
    carried = ends.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), *(F.lag(c).over(along).alias(f"{c}_in") for c in ("_held", "_open_from", "_open_to")))
    run = Window.partitionBy(key, "_range", "_island")
    local = parts.withColumn("_from", F.min(F.when(~known, F.col("_ms"))).over(run)).withColumn("_to", F.max(F.when(~known, F.col("_ms"))).over(run))
    local = local.withColumns({"_lead_from": F.min(F.when(F.col("_island") == 0, F.col("_from"))).over(Window.partitionBy(key, "_range")), "_lead_to": F.max(F.when(F.col("_island") == 0, F.col("_to"))).over(Window.partitionBy(key, "_range"))})
    local = local.where(known).withColumns({"_before": F.lag("_l").over(w), "_gap": F.lag(F.col("_to") - F.col("_from")).over(w), "_first": F.row_number().over(w) == 1})
    met = local.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    before = F.when(F.col("_first"), F.col("_held_in")).otherwise(F.col("_before"))
    lead = F.coalesce(F.greatest("_lead_to", "_open_to_in"), F.lit(-1)) - F.coalesce(F.least("_lead_from", "_open_from_in"), F.lit(0))
    gap = F.when(F.col("_first"), lead).otherwise(F.coalesce("_gap", F.lit(-1)))
    return met.where(before.isNull() | (before != F.col("_l")) | (gap >= release_ms)).select(*(c for c in rows.columns))


def with_lead_in(rows: DataFrame, key: str, ms: Column, window_ms: int, ranges: int, segment: str = "_segment", own: str = "_own") -> DataFrame:
    """Rows for windowed rules: ``segment`` names a range of one key, and holds its rows (``own``) and those of earlier ranges that reach into their windows.

    A row is repeated for each later range of its key that begins within ``window_ms`` of it.
    """
    parts = cut(rows.withColumn("_ms", ms), key, ["_ms"], ranges)
    sums = durable(parts.groupBy(key, "_range").agg(F.min("_ms").alias("_begin"), F.max("_ms").alias("_end")))
    later = Window.partitionBy(key).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    ahead = sums.withColumn("_all", F.collect_list(F.struct("_begin", F.col("_range").alias("to"))).over(later))
    ahead = ahead.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.filter("_all", lambda s: s["_begin"] <= F.col("_end") + window_ms).alias("_ahead"))
    met = parts.join(ahead, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    targets = F.array_union(F.array("_range"), F.transform(F.filter("_ahead", lambda s: s["_begin"] <= F.col("_ms") + window_ms), lambda s: s["to"]))
    out = met.withColumn("_to", F.explode(targets))
    return out.withColumn(segment, F.concat_ws("/", F.col("_to").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull().cast("string"))).withColumn(own, F.col("_to") == F.col("_range")).drop("_key", "_r", "_ahead", "_to", "_range")
