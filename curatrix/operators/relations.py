"""Joins, set relations and duplicate summaries (O-40..O-45, O-51..O-54, O-56, O-58..O-61, O-71, O-79, O-80, O-133)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.session import durable


def pair(left: DataFrame, right: DataFrame, key: str, last: str | None = None) -> DataFrame:
    """O-41: inner pairs by key; with ``last``, of right rows that share a key the one with the greatest ``last`` counts."""
    if last is not None:
        right = right.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(last)))).where("_rank = 1").drop("_rank")
    return left.join(right, key)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """O-42: (side, key) of keys on one side only."""
    only = lambda a, b, side: a.select(key).join(b.select(key), key, "left_anti").distinct().select(F.lit(side).alias("side"), F.col(key))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def mismatched(df: DataFrame, declared: Column, actual: Column) -> DataFrame:
    """O-40: rows whose declared name is not the actual one; nulls count as values."""
    return df.where(~declared.eqNullSafe(actual))


def split_overlap(df: DataFrame, digest: str, split: str, first: str, second: str) -> DataFrame:
    """O-43: one row: digests in both splits, and the rows of each that hold one."""
    sides = df.where(F.col(split).isin(first, second)).groupBy(digest).agg(*(F.count_if(F.col(split) == s).alias(f"_{k}") for k, s in enumerate((first, second))))
    both = sides.where("_0 > 0 and _1 > 0")
    return both.agg(F.count("*").alias("shared_hashes"), *(F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(name) for k, name in enumerate(("first_rows", "second_rows"))))


def mirror_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """O-44: one row: distinct keys missing on either side, and the rows they have on the left."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counts.agg(F.count_if(F.expr("l > 0 and r = 0")).alias("missing_right"), F.count_if(F.expr("l = 0 and r > 0")).alias("missing_left"), F.coalesce(F.sum(F.when(F.expr("r = 0"), F.col("l"))), F.lit(0)).alias("left_rows"))


def cross_collection(df: DataFrame, digest: str, collection: str, path: str) -> DataFrame:
    """O-45: digests held by more than one collection, the largest first by (-n, first_path)."""
    return df.groupBy(digest).agg(F.count("*").alias("n"), F.count_distinct(collection).alias("collections"), F.min(path).alias("first_path")).where("collections > 1").orderBy(F.desc("n"), "first_path")


def examples(df: DataFrame, key: str, order: Sequence[Column], keep: int = 25) -> DataFrame:
    """O-79: the first ``keep`` rows in order, with a flag that says whether there were more.

    Rows are limited before the exchange (a group limit below the window); the
    flag comes from a count that is aggregated beside it.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= keep)
    more = df.groupBy(F.col(key).alias("_key")).agg((F.count("*") > keep).alias("truncated"))
    return ranked.join(more, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def duplicate_summary(df: DataFrame, digest: str, label: str) -> DataFrame:
    """O-56: one row over groups of equal digest with two rows or more."""
    groups = df.groupBy(digest).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).where("n > 1")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(F.count("*").alias("group_count"), total("n").alias("files_in_groups"), total(F.col("n") - 1).alias("redundant_files"), F.count_if(F.expr("labels > 1")).alias("cross_label_groups"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """O-58: (field, value, n) of several columns in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def manifest_summary(df: DataFrame, split: str, source: str, label: str) -> DataFrame:
    """O-59, O-71: counts by nothing, split, source, (split, label) and (split, source), in one pass."""
    sets = df.groupingSets([[], [split], [source], [split, label], [split, source]], split, source, label)
    return sets.agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"))


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """O-60: how many keys have how many rows."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def annotation_counts(df: DataFrame, objects: str, folder: str) -> DataFrame:
    """O-61: (label, n, foreign) over all objects; an absent name is ``[missing]``, foreign counts those not of their folder."""
    each = df.select(folder, F.explode_outer(objects).alias("o")).where("o is not null")
    label = F.coalesce(F.nullif(F.trim("o.name"), F.lit("")), F.lit("[missing]"))
    return each.withColumn("label", label).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col(folder)).alias("foreign"))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """O-51: join by key that raises unless every key is on both sides exactly once."""
    keys = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    if not keys.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l <> 1 or r <> 1").isEmpty():
        raise ValueError(f"{key} does not align")
    return left.join(right, key)


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, **fields: Sequence[str]) -> DataFrame:
    """O-52, O-53: left join with fields taken from the first non-null of alternatives."""
    kept = dimension.select(key, *(F.coalesce(*names).alias(out) for out, names in fields.items()))
    return df.join(kept, key, "left")


def with_misses(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """O-54: rows without a prediction are predicted UNKNOWN."""
    return truth.join(predictions, key, "left").withColumn("pred", F.coalesce("pred", F.lit("UNKNOWN")))


def in_order(df: DataFrame, order: Sequence[str], position: str = "position") -> DataFrame:
    """O-80: the rows in a total order, with their places from 0; ranges of the order are sorted apart, and a range begins where those before it end.

    ``order`` has to tell rows apart for places to be the same in every run.
    """
    spark = df.sparkSession
    ranges = durable(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes, at = {r["_range"]: r["count"] for r in ranges.groupBy("_range").count().collect()}, 0
    offsets = []
    for k in sorted(sizes):
        offsets.append((k, at))
        at += sizes[k]
    places = spark.createDataFrame(offsets, "_range int, _at long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.join(F.broadcast(places), "_range").withColumn(position, F.col("_at") + number).drop("_range", "_at")
