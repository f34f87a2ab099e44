"""Difference hashes and Hamming distance (O-83, O-84)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_hash(grid: Column, rows: int = 8, columns: int = 9) -> Column:
    """O-83: one bit for each pair of neighbours in a row-major grid, first pair highest; set where left > right.

    The result is a long in two's complement; compare it by bits, not by size.
    """
    pairs = [(r * columns + c, r * columns + c + 1) for r in range(rows) for c in range(columns - 1)]
    at = F.array(*(F.lit(left) for left, _ in pairs))
    return F.aggregate(at, F.lit(0).cast("long"), lambda acc, k: F.shiftleft(acc, 1).bitwiseOR(F.when(F.get(grid, k) > F.get(grid, k + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    """O-84: number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))
