"""Ranked choices and circular order (O-76, O-77, O-81, O-92, O-140)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, item: str, by: Sequence[str] = ()) -> DataFrame:
    """O-76: previous and next item of the sorted list of each group, going round at both ends."""
    w = Window.partitionBy(*by).orderBy(item)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("previous", F.coalesce(F.lag(item).over(w), F.last(item).over(whole))).withColumn("next", F.coalesce(F.lead(item).over(w), F.first(item).over(whole)))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: int = 100) -> DataFrame:
    """O-77: the first ``keep`` rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= keep)


def best(df: DataFrame, *scores: Column, key: str) -> DataFrame:
    """O-81: the row with the greatest scores in turn; the smallest key wins a tie."""
    return df.orderBy(*(s.desc() for s in scores), key).limit(1)


def lookup_letters(catalog: DataFrame, letters: Sequence[str], rank: str = "rank", letter: str = "letter") -> DataFrame:
    """O-92 of several letters at once, case ignored: their best entries, from one pass over the catalog."""
    return catalog.where(F.upper(letter).isin([x.upper() for x in letters]) & (F.col(rank) == 1))


def letter_coverage(modes: DataFrame, letters: Sequence[str], candidates: DataFrame, static: Column) -> DataFrame:
    """O-140: (mode, letter, form, candidate) for every letter of every mode; a missing candidate is an error when read."""
    frame = modes.select("mode", F.explode(F.array(*map(F.lit, letters))).alias("letter"))
    first = candidates.where("rank = 1").select("mode", "letter", "candidate")
    full = frame.join(first, ["mode", "letter"], "left")
    need = F.coalesce("candidate", F.raise_error(F.concat_ws(" ", F.lit("no candidate for"), "mode", "letter")).cast("string"))
    return full.select("mode", "letter", F.when(static, "static").otherwise("dynamic").alias("form"), need.alias("candidate"))
