"""Hamming-radius joins over 64-bit hashes (O-46, O-48) and a stored index of hashes (O-47).

Of d + 1 bands of bits at least one is equal in hashes d or fewer bits apart, so
pairs meet by an equi-join on (label, band, value) and are verified. A pair is
taken in its first equal band only, which leaves nothing to make distinct.
Distinct hashes are joined and their row counts multiplied, so copies of one
hash are never expanded into pairs.

Bits are dealt to bands by how often they differ, so that no band is made of bits that are
the same nearly everywhere. Where one value of a band still gathers many hashes, they are banded once
more by their other bits.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.bits import hamming
from curatrix.session import durable

#: Hashes of one band value that are joined as they are; beyond, they are banded again.
CROWD = 512


def bit_shares(hashes: DataFrame) -> list[float]:
    """Share of the rows of ``h`` that have each bit set, lowest bit first; one row of sums comes back."""
    found = hashes.agg(F.count("h").alias("n"), *(F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64))).first()
    return [(found[f"b{k}"] or 0) / max(found["n"], 1) for k in range(64)]


def dealt_bits(shares: Sequence[float], bands: int, among: Sequence[int] = tuple(range(64))) -> list[list[int]]:
    """``among`` dealt into bands, the most even bits first and to and fro, so that every band tells hashes apart about as well."""
    out: list[list[int]] = [[] for _ in range(bands)]
    for k, bit in enumerate(sorted(among, key=lambda b: (abs(shares[b] - 0.5), b))):
        turn, place = divmod(k, bands)
        out[place if turn % 2 == 0 else bands - 1 - place].append(bit)
    return out


def band_value(h: Column, bits: Sequence[int]) -> Column:
    """The bits of a hash at the given places, packed into a long."""
    picked = (F.shiftleft(F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(1)).cast("long"), k) for k, bit in enumerate(bits))
    return reduce(lambda a, b: a.bitwiseOR(b), picked, F.lit(0).cast("long"))


def hamming_join(left: DataFrame, right: DataFrame, label: str, distance: int, keep: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """(label, h1, h2, d) of hashes within the distance, from frames with columns label and h (distinct).

    Columns in ``keep`` of either side come along with 1 or 2 after their names.
    """
    if not 0 <= distance <= 8:
        raise ValueError("distance must be from 0 to 8")
    shares = bit_shares(left)
    first = dealt_bits(shares, distance + 1)
    second = [dealt_bits(shares, distance + 1, [b for b in range(64) if b not in band]) for band in first]

    def banded(df: DataFrame, side: str) -> DataFrame:
        values = F.array(*(band_value(F.col("h"), band) for band in first))
        rows = df.select(label, F.col("h").alias(f"h{side}"), *(F.col(c).alias(f"{c}{side}") for c in keep), values.alias(f"v{side}"))
        return rows.select("*", F.posexplode(f"v{side}").alias("band", "value"))

    def again(df: DataFrame, side: str) -> DataFrame:
        values = reduce(lambda out, k: F.when(F.col("band") == k, F.array(*(band_value(F.col(f"h{side}"), b) for b in second[k]))).otherwise(out), range(distance + 1), F.lit(None).cast("array<bigint>"))
        rows = df.withColumn(f"w{side}", values)
        return rows.select("*", F.posexplode(f"w{side}").alias("part", "inner"))

    met_first = lambda name: F.array_position(F.zip_with(f"{name}1", f"{name}2", lambda a, b: a == b), F.lit(True)) - 1
    one, two, key = banded(left, "1"), banded(right, "2"), [label, "band", "value"]
    crowds = durable(one.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > crowd).drop("n"))
    few = crowds.count() <= 100_000  # broadcast only then
    crowds = F.broadcast(crowds) if few else crowds
    plain = one.join(crowds, key, "left_anti").join(two.join(crowds, key, "left_anti"), key)
    dense = again(one.join(crowds, key, "left_semi"), "1").join(again(two.join(crowds, key, "left_semi"), "2"), [*key, "part", "inner"]).where(met_first("w") == F.col("part"))
    columns = [label, "h1", "h2", *(f"{c}{side}" for side in "12" for c in keep), "v1", "v2", "band"]
    d = hamming(F.col("h1"), F.col("h2"))
    near = plain.select(*columns).unionByName(dense.select(*columns)).where((d <= distance) & (met_first("v") == F.col("band")))
    return near.select(label, "h1", "h2", *columns[3 : 3 + 2 * len(keep)], d.alias("d"))


class HammingIndex:
    """O-47: hashes in tables on shared storage that take inserts and answer batches of radius queries.

    A folder holds the layout (bands of bits, dealt at the first insert), and for each
    commit its entries (label, band, value, h, n) and, written last, a marker; what a failed
    insert leaves has no marker and is not read. Old entries are neither hashed nor joined by an insert; a hash
    that comes again has an entry in each of its commits, and their counts are added when it is found.

    Queries use multi-index hashing: hashes within a radius r agree in one of m bands but for r // m bits (one less in the bands
    after the first r % m + 1), so a query probes the values that near its own, in each band. Any radius is exact; the
    probes of a query grow with the radius, and ``probes`` tells how many there are.
    """

    def __init__(self, spark: SparkSession, path: str, label: str = "label") -> None:
        self.spark, self.path, self.label = spark, path, label

    def _read(self, name: str) -> DataFrame | None:
        """A table of committed parts, or None."""
        commits = self._commits()
        return self.spark.read.parquet(*(f"{self.path}/{name}/{c}" for c in commits)) if commits else None

    def _commits(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in store.listStatus(root) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if store.exists(root) else []

    def layout(self) -> list[list[int]] | None:
        """The bits of each band, from the first commit's marker."""
        commits = self._commits()
        return json.loads(self.spark.read.text(f"{self.path}/commits/{commits[0]}").first()[0]) if commits else None

    def insert(self, rows: DataFrame, bands: int = 4) -> None:
        """Adds rows with columns label and h; ``bands`` counts at the first insert only. Null hashes are left out."""
        hashes = durable(rows.where("h is not null").groupBy(self.label, "h").agg(F.count("*").alias("n")))
        layout = self.layout() or dealt_bits(bit_shares(hashes), bands)
        name = f"{len(self._commits()):06d}-{uuid4().hex}"
        entries = hashes.select("*", F.posexplode(F.array(*(band_value(F.col("h"), b) for b in layout))).alias("band", "value"))
        entries.write.parquet(f"{self.path}/entries/{name}")
        self.spark.createDataFrame([(json.dumps(layout),)], "layout string").coalesce(1).write.text(f"{self.path}/commits/{name}")

    @staticmethod
    def reach(layout: list[list[int]], radius: int) -> list[int]:
        """Bits by which each band may differ; -1 for a band that need not be asked."""
        whole, rest = divmod(radius, len(layout))
        return [whole if k <= rest else whole - 1 for k in range(len(layout))]

    @staticmethod
    def masks(width: int, reach: int) -> list[int]:
        return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in itertools.combinations(range(width), n)]

    def probes(self, radius: int) -> int:
        """Values that one query hash asks for."""
        layout = self.layout() or []
        return sum(len(self.masks(len(b), r)) for b, r in zip(layout, self.reach(layout, radius), strict=True))

    def query(self, asked: DataFrame, radius: int) -> DataFrame:
        """(label, h, found, d, n): hashes of the index within the radius of each distinct one asked for, with the rows they stand for."""
        entries, layout, label = self._read("entries"), self.layout(), self.label
        hashes = asked.select(label, F.col("h").cast("long").alias("h")).where("h is not null").distinct()
        if entries is None or layout is None:
            return hashes.select(label, "h", F.col("h").alias("found"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("n")).limit(0)
        reach = self.reach(layout, radius)
        probes = None
        for k, (bits, r) in enumerate(zip(layout, reach, strict=True)):
            if r < 0:
                continue
            near = F.transform(F.array(*(F.lit(m).cast("long") for m in self.masks(len(bits), r))), F.col("own").bitwiseXOR)
            own = hashes.select(label, F.col("h").alias("asked"), F.lit(k).alias("band"), band_value(F.col("h"), bits).alias("own"))
            part = own.select(label, "asked", "band", F.explode(near).alias("value"))
            probes = part if probes is None else probes.unionByName(part)
        apart = [hamming(band_value(F.col("asked"), bits), band_value(F.col("h"), bits)) <= r for bits, r in zip(layout, reach, strict=True)]
        first = F.coalesce(*(F.when(near, k) for k, near in enumerate(apart)))
        d = hamming(F.col("asked"), F.col("h"))
        met = probes.join(entries, [label, "band", "value"]).where((d <= radius) & (first == F.col("band")))
        return met.groupBy(label, F.col("asked").alias("h"), F.col("h").alias("found")).agg(F.first(d).alias("d"), F.sum("n").alias("n"))

    def largest_share(self) -> float:
        """Share of all hashes that the fullest value of any band holds."""
        entries = self._read("entries")
        found = entries.groupBy("band", "value").agg(F.count("*").alias("n")).groupBy("band").agg((F.max("n") / F.sum("n")).alias("share")) if entries is not None else None
        return found.agg(F.max("share")).first()[0] or 0.0 if found is not None else 0.0


def similarity_audit(df: DataFrame, distance: int, label: str = "label", split: str = "split", splits: tuple[str, str, str] = ("train", "val", "test")) -> DataFrame:
    """O-46: (first_split, second_split, pairs) of near rows of one label across each pair of splits."""
    counts = df.groupBy(label, split, "h").agg(F.count("*").alias("n"))
    order = {s: k for k, s in enumerate(splits)}
    hashes = durable(counts.select(label, "h").distinct())
    near = hamming_join(hashes, hashes, label, distance)
    a = counts.select(label, F.col(split).alias("first_split"), F.col("h").alias("h1"), F.col("n").alias("n1"))
    b = counts.select(label, F.col(split).alias("second_split"), F.col("h").alias("h2"), F.col("n").alias("n2"))
    rank = lambda c: F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col(c)]
    met = near.join(a, [label, "h1"]).join(b, [label, "h2"]).where(rank("first_split") < rank("second_split"))
    return met.groupBy("first_split", "second_split").agg(F.sum(F.col("n1") * F.col("n2")).alias("pairs"))


def later_split_rejects(df: DataFrame, distance: int, label: str = "label", split: str = "split") -> DataFrame:
    """O-48: rows (with their columns) of val near train, and of test near train or accepted val.

    Rejected val rows do not block test rows, and rows of one split do not block
    each other. Distinct hashes are joined once, and all decisions are made on
    them; rows meet the rejected hashes at the end.
    """
    hashes = durable(df.select(label, split, "h").distinct())
    every = durable(hashes.select(label, "h").distinct())
    near = durable(hamming_join(every, every, label, distance).select(label, "h1", "h2"))
    of = lambda name: hashes.where(F.col(split) == name).select(label, "h")

    def blocked(rows: DataFrame, by: DataFrame) -> DataFrame:
        hit = near.join(by.withColumnRenamed("h", "h2"), [label, "h2"], "left_semi").select(label, F.col("h1").alias("h")).distinct()
        return rows.join(hit, [label, "h"], "left_semi")

    val_out = durable(blocked(of("val"), of("train")))
    val_in = of("val").join(val_out, [label, "h"], "left_anti")
    test_out = blocked(of("test"), of("train").unionByName(val_in))
    out = val_out.withColumn(split, F.lit("val")).unionByName(test_out.withColumn(split, F.lit("test")))
    return df.join(out, [label, split, "h"], "left_semi")
