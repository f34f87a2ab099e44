"""Hamming joins and the stored index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import similarity


def signed(values):
    return [int(np.uint64(v).astype(np.int64)) for v in values]


def crowded(n, seed):
    """Hashes with few set bits, whose upper half is almost always zero, beside some at random."""
    rng = np.random.default_rng(seed)
    sparse = [sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False)) for _ in range(n)]
    return sorted(set(signed(sparse) + signed(rng.integers(0, 1 << 63, n // 4, dtype=np.uint64) * np.uint64(2))))


def apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize(("distance", "crowd"), [(0, 512), (2, 512), (2, 5), (4, 3)])
def test_join_is_all_pairs_however_crowded(spark, distance, crowd):
    hashes = crowded(300, 1)
    df = spark.createDataFrame([("a", h, k) for k, h in enumerate(hashes)] + [("b", hashes[0], -1)], "label string, h long, n int")
    got = sorted((r["label"], r["h1"], r["h2"], r["n1"], r["n2"], r["d"]) for r in similarity.hamming_join(df, df, "label", distance, keep=("n",), crowd=crowd).collect())
    want = sorted([("a", x, y, i, j, apart(x, y)) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if apart(x, y) <= distance] + [("b", hashes[0], hashes[0], -1, -1, 0)])
    assert got == want


def test_bits_are_dealt_by_evenness():
    shares = [0.0] * 32 + [0.5] * 32
    bands = similarity.dealt_bits(shares, 4)
    assert sorted(b for band in bands for b in band) == list(range(64))
    assert [sum(b >= 32 for b in band) for band in bands] == [8] * 4


def test_reach_and_masks():
    layout = [[0]] * 4
    assert similarity.HammingIndex.reach(layout, 6) == [1, 1, 1, 0] and similarity.HammingIndex.reach(layout, 2) == [0, 0, 0, -1]
    assert sorted(similarity.HammingIndex.masks(3, 2)) == [0, 1, 2, 3, 4, 5, 6] and similarity.HammingIndex.masks(5, 0) == [0]


@pytest.mark.parametrize("radius", [0, 3, 7, 13])
def test_index_in_two_runs_is_all_pairs(spark, tmp_path, radius):
    old, new = crowded(200, 2), crowded(120, 3)
    rows = lambda hashes: spark.createDataFrame([("x", h) for h in hashes] + [("x", hashes[0]), ("y", hashes[1]), ("x", None), (None, 5)], "label string, h long").withColumn("n", F.lit("x"))
    index = similarity.HammingIndex(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([("x", h) for h in (*old[:9], *new[:9], 77)] + [("x", 77), ("x", None), ("z", old[0])], "label string, h long")
    assert index.query(asked, radius).count() == 0 and index.largest_share() == 0
    index.insert(rows(old))
    layout = index.layout()
    index.insert(rows(new))
    rows(old).select("label", "h", F.lit(1).alias("n"), F.lit(0).alias("band"), F.lit(0).cast("long").alias("value")).write.parquet(f"file://{tmp_path}/index/entries/failed")
    again = similarity.HammingIndex(spark, f"file://{tmp_path}/index")
    assert again.layout() == layout and again.probes(radius) >= 1
    stored = {}
    for h in (*old, old[0], *new, new[0]):
        stored[h] = stored.get(h, 0) + 1
    want = sorted((q, h, apart(q, h), n) for q in {*old[:9], *new[:9], 77} for h, n in stored.items() if apart(q, h) <= radius)
    assert sorted((r["h"], r["found"], r["d"], r["n"]) for r in again.query(asked, radius).collect() if r["label"] == "x") == want
    assert again.largest_share() < 0.5
