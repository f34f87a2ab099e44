"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import durable


#: Shares that the rows of one key are dealt into where they meet the key's one row.
SHARES = 8


def meet(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """The equi-join (or left join) of ``rows`` with ``one``, which has a row for each ``key``.

    The rows of a key are dealt into ``SHARES`` by a hash of the column ``by`` and
    the key's row is repeated for each of them, so a hot key is no single task's.
    """
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int"))
    every = one.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(every, [key, "_share"], how).drop("_share")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs -> (node, label), the label being the smallest node reachable.

    Every round hangs each node's larger neighbours on its smallest one, then the
    smaller ones likewise, so paths shrink to stars in about log(n) rounds. Hot
    nodes meet only an aggregate and an equi-join in shares, never a collected list. Loops
    and null ends are left out. Each round is written to the checkpoint folder.
    """
    u, v = F.col("u"), F.col("v")
    edges = durable(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    before = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = meet(both.where(v > u), low, "u", "v").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, low, "u", "v").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where(u != v).distinct()
        edges = durable(small)
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(u.alias("node"), v.alias("label"))
    return stars.unionByName(edges.select(v.alias("node"), v.alias("label")).distinct())
