"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a hash, are cut into blocks.
With a source's weight w, its block i (from 0) may not start before slot
floor(i / w) and has to end by slot ceil((i + 1) / w); earliest deadline first
over the released blocks then keeps every source within less than one block of
w * t at every slot t. Weights are taken exactly, as whole numbers with a common
divisor; after their sum in slots the schedule repeats, so one period of it is made. When a source runs out, the
weights of the others are scaled up and a new phase begins; no row is dropped or
repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import durable, fresh, table


def whole_weights(weights: np.ndarray) -> list[int]:
    """Positive integers in exactly the proportions of the weights as they are written: 0.1 is a tenth."""
    exact = [Fraction(str(w)) for w in np.asarray(weights).tolist()]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be positive")
    common = lcm(*(w.denominator for w in exact))
    return [int(w * common) for w in exact]


@dataclass
class Phase:
    """Slots [start, stop) of the whole schedule, in which the sources with blocks left keep to their weights.

    ``slots`` has the source of each slot up to the period of the weights, after which they repeat.
    """

    start: int
    stop: int
    slots: np.ndarray
    finish: np.ndarray
    whole: list[int]
    plan: list[Phase]

    @property
    def sources(self) -> np.ndarray:
        return np.flatnonzero(self.finish > self.start)

    @property
    def counts(self) -> np.ndarray:
        """The sources' whole weights, as Python integers of any size."""
        return np.array([self.whole[s] for s in self.sources.tolist()], dtype=object)

    @property
    def pattern(self) -> np.ndarray:
        """Place in ``sources`` of each slot's source."""
        return np.searchsorted(self.sources, self.slots)

    @property
    def order(self) -> np.ndarray:
        """The source of every slot of the whole schedule, written out; tasks do without."""
        return np.concatenate([np.resize(p.slots, p.stop - p.start) for p in self.plan])


def _slots(active: list[int], whole: list[int], left: list[int], total: int) -> Iterator[int]:
    """Sources of a phase's slots from its start, earliest deadline first, until one of them has run out or ``total``, the sum of their weights, are made.

    Deadlines are ordered by (i + 1) / weight; sources that have not had a block in the phase wait in
    one sorted list, so a phase costs its slots, not its sources.
    """
    fine = total * total  # two different deadlines (i + 1) / a differ by 1 / total ** 2 at least
    at, t = 0, 0
    waiting: list[tuple[int, int, int]] = []  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    while t < total:
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, ((i + 1) * fine // whole[s], s, i))
        first = (fine // whole[active[at]], active[at], 0) if at < len(active) else None
        if first is not None and (not ready or first < ready[0]):
            at += 1
            _, s, i = first
        else:
            _, s, i = heapq.heappop(ready)
        if t * whole[s] >= (i + 1) * total:
            raise AssertionError("a block missed its deadline")
        yield s
        t += 1
        if i + 1 == left[s]:
            return
        heapq.heappush(waiting, ((i + 1) * total // whole[s], s, i + 1))


def schedule(blocks: np.ndarray, weights: np.ndarray) -> list[Phase]:
    """Phases that hold every block of every source once.

    After as many slots as the weights have in all (in lowest terms) every source has exactly its share, so the slots
    repeat from there: a phase is made up to that period, or to its end if that comes first. Its length does not
    matter beyond the period, so weights of a few digits cost the same for any number of blocks.
    """
    whole, left = whole_weights(weights), np.asarray(blocks, dtype=np.int64).tolist()
    common = gcd(*(a for a, n in zip(whole, left, strict=True) if n > 0)) or 1
    whole = [a // common for a in whole]
    active = sorted((s for s, n in enumerate(left) if n > 0), key=lambda s: (Fraction(1, whole[s]), s))
    phases: list[Phase] = []
    finish, t, total = np.zeros(len(left), dtype=np.int64), 0, sum(whole[s] for s in active)
    while active:
        slots = np.fromiter(_slots(active, whole, left, total), dtype=np.int64)
        sources, place, times = np.unique(slots, return_inverse=True, return_counts=True)
        have = np.array([left[s] for s in sources.tolist()])
        cycles, last = 0, len(slots)
        if len(slots) == total:
            cycles = int(((have - 1) // times).min())  # whole periods before the one in which a source runs out
            turn = np.empty(total, dtype=np.int64)  # which block of its source a slot of the period is
            turn[np.argsort(place, kind="stable")] = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
            last = int(np.flatnonzero(turn == (have - cycles * times - 1)[place])[0]) + 1
        for s, n in zip(sources.tolist(), (cycles * times + np.bincount(place[:last], minlength=len(sources))).tolist(), strict=True):
            left[s] -= n
        start, t = t, t + cycles * len(slots) + last
        ended = int(slots[last - 1])
        finish[ended] = t
        total -= whole[ended]
        active.remove(ended)
        phases.append(Phase(start, t, slots, finish, whole, phases))
    return phases


class Places:
    """Slots of blocks, from arrays whose size follows the phases' patterns, not the blocks."""

    def __init__(self, phases: list[Phase], blocks: np.ndarray) -> None:
        self.begins = np.cumsum(blocks) - blocks
        done, rows, pool, size = np.zeros(len(blocks), dtype=np.int64), [], [], 0
        for p in phases:
            cycles, last = divmod(p.stop - p.start, len(p.slots))
            slots = p.slots if cycles else p.slots[:last]
            sources, place, times = np.unique(slots, return_inverse=True, return_counts=True)
            rows.append(np.stack([self.begins[sources] + done[sources], np.full(len(sources), p.start), np.full(len(sources), len(slots)), size + np.cumsum(times) - times, times]))
            pool.append(np.argsort(place, kind="stable"))
            size += len(slots)
            done[sources] += cycles * times + (np.bincount(place[:last], minlength=len(sources)) if cycles else times)
        table = np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), dtype=np.int64)
        self.first, self.start, self.period, self.offset, self.times = table[:, np.argsort(table[0], kind="stable")]
        self.pool = np.concatenate(pool) if pool else np.empty(0, dtype=np.int64)

    def slot(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The slots of blocks, given their sources' numbers."""
        number = self.begins[source] + block
        k = np.searchsorted(self.first, number, side="right") - 1
        cycle, turn = np.divmod(number - self.first[k], self.times[k])
        return self.start[k] + cycle * self.period[k] + self.pool[self.offset[k] + turn]


def slots_of(phases: list[Phase], source: int, block: np.ndarray) -> np.ndarray:
    """Slot of each of a source's blocks."""
    blocks = np.bincount(phases[0].order)
    return Places(phases, blocks).slot(np.full(len(block), source), block)


#: Target weights of the query: the web source thrice each of the others.
WEIGHTS = {"src0": 3.0}


def row_hash(docs: DataFrame, id_col: str, text_col: str | None) -> Column:
    """What orders a source's rows: a hash of the id and the text, so rows without an id are spread too."""
    return F.xxhash64(id_col) if text_col is None else F.xxhash64(F.xxhash64(id_col), text_col)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    other: float = 0.0,
    alpha: float = 0.5,
    block_rows: int = 64,
    bucket_rows: int = 4096,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str | None = None,
) -> DataFrame:
    """(doc_id, source, block, slot, place, key) for every row; (slot, place) orders the mixture.

    ``weights`` are the targets by source, ``other`` that of sources without one;
    without weights a source's target is its row count to the power ``alpha``, in
    65,536ths of the greatest. A weight of zero raises an error; a null source is the source ''. ``place`` is
    the row's place in its block; ``key`` is the hash that orders a source's rows,
    of the id and, where it is named, the text. Sources may be any number: one row for each of them
    and each phase's pattern, no longer than the weights' period, are held by the driver and sent to the tasks;
    nothing there grows with the blocks, unless weights are written with so many digits that their period is longer than the schedule.
    One row for each run of about ``bucket_rows`` rows is counted beside the rows.
    A source's rank is the offset of its hash
    bucket plus the rank within that bucket, so a hot source is spread over many
    tasks. Repeated rows keep a place each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), row_hash(docs, id_col, text_col).alias("key"))
    sizes = rows.groupBy("source").count().toPandas().sort_values("source")
    names, counts = sizes["source"].tolist(), sizes["count"].to_numpy(dtype=np.int64)
    target = np.round(counts.astype(np.float64) ** alpha / (counts**alpha).max(initial=1) * 65536).clip(1) if weights is None else np.array([weights.get(s, other) for s in names], dtype=np.float64)
    if (target <= 0).any():
        raise ValueError(f"no weight for {[s for s, w in zip(names, target, strict=True) if w <= 0]}")
    blocks = -(-counts // block_rows)
    # tasks get the phases' patterns, from which they find the slot of any block
    shared = spark.sparkContext.broadcast(({s: k for k, s in enumerate(names)}, Places(schedule(blocks, target), blocks)))

    # the order within a source: the key, of which the upper 32 bits make the buckets, then the id
    parts = spark.createDataFrame([(s, max(1, int(n) // bucket_rows)) for s, n in zip(names, counts.tolist(), strict=True)], "source string, _parts long")
    hashed = rows.withColumn("_h", F.shiftright("key", 32) + (1 << 31)).join(F.broadcast(parts), "source")
    hashed = hashed.withColumn("_bucket", F.shiftright(F.col("_h") * F.col("_parts"), 32).cast("int"))
    totals = hashed.groupBy("source", "_bucket").count()
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "_bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("source", "_bucket").orderBy("key", "doc_id")
    ranked = hashed.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["source", "_bucket"])
    ranked = ranked.select("doc_id", "source", (F.col("_ahead") + F.col("_rank")).alias("_rank"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, places = shared.value
        for batch in batches:
            rank = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            source = np.array([index[s] for s in batch.column(1).to_pylist()], dtype=np.int64)
            block, place = np.divmod(rank, block_rows)
            slot = places.slot(source, block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block), pa.array(slot), pa.array(place), batch.column(3)], names=["doc_id", "source", "block", "slot", "place", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, source string, block long, slot long, place long, key long")


def in_mixed_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` sorted into the mixture's order; all rows and columns stay.

    Rows meet their places by the key; rows of the same id and text are equal in
    it and take its first place together. Written files keep the order: by name,
    and by row within a file.
    """
    mixed, at = fresh(docs, "_mixed"), fresh(docs, "_at")
    order = durable(mix(docs, id_col=id_col, text_col=text_col, **params).groupBy("key").agg(F.min(F.struct("slot", "place")).alias(at)))
    placed = docs.withColumn(mixed, row_hash(docs, id_col, text_col)).join(order.withColumnRenamed("key", mixed), mixed)
    return placed.orderBy(f"{at}.slot", f"{at}.place").select(docs.columns)


def file_order(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, read from files that Spark wrote, with the order of their rows in the column ``name``.

    The number is made of the file's part number, its number within the part, and
    the row's place in the file. Rows that come from no file take the order in
    which Spark deals them.
    """
    try:
        file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        docs.select(file, row).schema  # noqa: B018  raises where there is no file
    except AnalysisException:
        return docs.withColumn(name, F.monotonically_increasing_id())
    number = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))
    return docs.withColumn(name, F.shiftleft(number(r"^part-(\d+)"), 43) + F.shiftleft(number(r"-c(\d+)[.]"), 31) + row)


def op4_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """All documents with their source's block, its slot and the row's place in it, at the targets ``WEIGHTS``."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, WEIGHTS, other=1.0, text_col="text").drop("key")
