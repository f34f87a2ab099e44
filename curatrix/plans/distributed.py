"""Training of small networks over tables of any size (O-105, O-125, O-128).

Rows stay where they are: a step sends the network (bounded by its layers, never by rows) to
the tasks, and sums of gradients come back through a tree of aggregates. Rows lie in groups by a hash of
their key, sorted, and are taken in blocks of ``BLOCK`` rows; sums are added in the order of blocks, groups and
tree nodes, so the result does not depend on partitions, batches or the number of executors. Every epoch's
network and optimiser are written to shared storage, and a run that finds them goes on from the last one.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.plans.training import export
from curatrix.session import durable

BLOCK = 256
#: Sums that one node of the tree adds up, and that the driver takes at most.
FAN = 32
Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def prepared(df: DataFrame, vector: Column, label: Column, key: Column, classes: Sequence[str], weight: Column | None = None, group_rows: int = 20_000) -> DataFrame:
    """(group, key, x, y, w): a written table for training; labels outside ``classes`` and null vectors are left out.

    Equal keys stand in the order of their values.
    """
    index = F.array_position(F.array(*map(F.lit, classes)), label.cast("string")) - 1
    rows = df.select(key.cast("string").alias("key"), vector.cast("array<double>").alias("x"), index.cast("int").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")).where("y >= 0 AND x IS NOT NULL")
    groups = max(1, rows.count() // group_rows)
    mixed = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")
    return durable(rows.withColumn("group", mixed).repartition("group").sortWithinPartitions("group", "key", "y", "w", "x").select("group", "key", "x", "y", "w"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, last of it, x, y, w) of ``BLOCK`` rows or a group's rest, however the rows were batched."""
    held: list[tuple] = []

    def taken(rows: list[tuple]):
        return np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])

    def cut(last: bool):
        nonlocal held
        x, y, w = taken(held)
        g, at = held[0][0], 0
        while len(y) - at > BLOCK or (last and at < len(y)):
            end = min(at + BLOCK, len(y))
            yield g, last and end == len(y), x[at:end], y[at:end], w[at:end]
            at = end
        held = [] if last else [(g, x[at:], y[at:], w[at:])]

    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        lists = batch.column(2)
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y, w = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy()
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
        for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
            if held and held[0][0] != group[a]:
                yield from cut(True)
            held.append((int(group[a]), x[a:b], y[a:b], w[a:b]))
            yield from cut(False)
    if held:
        yield from cut(True)


def tree_sum(rows: DataFrame, of: Sums) -> np.ndarray:
    """The sum of ``of(x, y, w)`` over all blocks of a prepared table, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for group, last, x, y, w in _blocks(batches):
            part = of(x, y, w)
            total = part if total is None else total + part
            if last:
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["node", "sums"])
                total = None

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        total = sum(np.frombuffer(s.as_buffer(), dtype=np.float64) for s in group["sums"])
        return pa.table({"node": pa.array([group["node"][0].as_py() // FAN], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    nodes = rows.mapInArrow(run, "node int, sums binary")
    count = (rows.agg(F.max("group")).first()[0] or 0) + 1
    while count > FAN:
        nodes = nodes.withColumn("_above", F.floor(F.col("node") / FAN)).groupBy("_above").applyInArrow(merge, "node int, sums binary")
        count = -(-count // FAN)
    found = sorted(nodes.collect(), key=lambda r: r["node"])  # FAN rows at most
    return sum((np.frombuffer(r["sums"], dtype=np.float64) for r in found), np.zeros(1))


@dataclass
class Network:
    """Layers, their scaler, and the optimiser's moments."""

    sizes: list[int]
    mean: np.ndarray
    scale: np.ndarray
    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    scores: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def layers(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, at, out = self.flat if flat is None else flat, 0, []
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """The input, every layer's result, and probabilities last."""
        acts, net = [(x - self.mean) / self.scale], self.layers()
        for k, (m, b) in enumerate(net):
            h = acts[-1] @ m + b
            acts.append(np.maximum(h, 0) if k < len(net) - 1 else h)
        p = np.exp(acts[-1] - acts[-1].max(axis=1, keepdims=True))
        acts[-1] = p / p.sum(axis=1, keepdims=True)
        return acts

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted sums over rows: the gradient of the cross-entropy, the cross-entropy, and the weights."""
        acts, net = self.outputs(x), self.layers()
        d = acts[-1].copy()
        loss = -(w * np.log(np.maximum(d[np.arange(len(y)), y], 1e-300))).sum()
        d[np.arange(len(y)), y] -= 1
        d *= w[:, None]
        grads: list[np.ndarray] = []
        for k in range(len(net) - 1, -1, -1):
            grads[:0] = [(acts[k].T @ d).ravel(), d.sum(axis=0)]
            if k:
                d = (d @ net[k][0].T) * (acts[k] > 0)
        return np.concatenate([*grads, [loss, w.sum()]])

    def step(self, sums: np.ndarray, rate: float, alpha: float, rows: int) -> None:
        """One step of Adam along the mean gradient, with L2 on the matrices."""
        g, decay = sums[:-2] / sums[-1], np.zeros_like(self.flat)
        for (m, _), (to, _) in zip(self.layers(), self.layers(decay), strict=True):
            to[:] = alpha * m / rows
        g = g + decay
        self.steps += 1
        self.first += 0.1 * (g - self.first)
        self.second += 0.001 * (g * g - self.second)
        self.flat -= rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)
        self.losses.append(float(sums[-2] / sums[-1]))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: np.asarray(v) for k, v in vars(self).items()})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Network:
        z = np.load(io.BytesIO(data))
        return cls(z["sizes"].tolist(), z["mean"], z["scale"], z["flat"].copy(), z["first"].copy(), z["second"].copy(), int(z["steps"]), z["scores"].tolist(), z["losses"].tolist())


def started(rows: DataFrame, classes: int, hidden: Sequence[int], seed: int) -> Network:
    """A network with the scaler of a prepared table (two passes), before its first step."""
    moments = tree_sum(rows, lambda x, y, w: np.append(x.sum(axis=0), len(x)))
    if len(moments) < 2:
        raise ValueError("no training rows")
    mean = moments[:-1] / moments[-1]
    spread = tree_sum(rows, lambda x, y, w: ((x - mean) ** 2).sum(axis=0)) / moments[-1]
    sizes, rng = [len(mean), *hidden, classes], np.random.default_rng(seed)
    flat = np.concatenate([np.append((rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))).ravel(), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])
    return Network(sizes, mean, np.where(spread > 0, np.sqrt(spread), 1.0), flat, np.zeros_like(flat), np.zeros_like(flat))


def validation_f1(rows: DataFrame, net: Network, classes: int) -> float:
    """Macro F1 from counts of (label, prediction), a row for each cell and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((classes, classes), dtype=np.int64)
        for _, _, x, y, _ in _blocks(batches):
            np.add.at(table, (y, net.outputs(x)[-1].argmax(axis=1)), 1)
        y, said = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(said), pa.array(table[y, said])], names=["y", "said", "n"])

    cells = rows.mapInArrow(run, "y long, said long, n long").groupBy("y", "said").agg(F.sum("n").alias("n")).collect()
    y, said, n = (np.array([r[c] for r in cells], dtype=np.int64) for c in ("y", "said", "n"))
    table = np.zeros((classes, classes))
    np.add.at(table, (y, said), n)
    both = table.sum(axis=0) + table.sum(axis=1)
    return float(np.mean(np.divide(2 * np.diag(table), both, out=np.zeros(classes), where=both > 0)))


def train(rows: DataFrame, validation: DataFrame, classes: Sequence[str], at: str, hidden: Sequence[int] = (128, 64), epochs: int = 60, patience: int = 8, rate: float = 1e-2, alpha: float = 5e-4, better: float = 1e-4, seed: int = 20260825) -> tuple[dict, Network]:
    """O-125: the best epoch's network as a model document, and the last one with the scores and losses by epoch.

    ``rows`` and ``validation`` are prepared tables; a step follows the gradient of all rows. Epochs are written below
    ``at``; what stands there is gone on from. Stops after ``patience`` epochs without a gain of ``better``.
    """
    spark = rows.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    there = lambda k: (p := files.Path(f"{at}/epoch-{k:05d}/_SUCCESS")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    load = lambda k: Network.unpacked(bytes(spark.read.parquet(f"{at}/epoch-{k:05d}").first()["net"]))
    done = 0
    while there(done + 1):
        done += 1
    net = load(done) if done else started(rows, len(classes), hidden, seed)
    n = rows.count()

    def stopped() -> tuple[int, bool]:
        """The best epoch so far, and whether patience has run out."""
        best, epoch = -1.0, 0
        for k, score in enumerate(net.scores, 1):
            if score > best + better:
                best, epoch = score, k
        return epoch, len(net.scores) - epoch >= patience

    while len(net.scores) < epochs and not stopped()[1]:
        sent = Network(net.sizes, net.mean, net.scale, net.flat, net.first[:0], net.second[:0])
        net.step(tree_sum(rows, sent.gradient), rate, alpha, n)
        sent = Network(net.sizes, net.mean, net.scale, net.flat, net.first[:0], net.second[:0])
        net.scores.append(validation_f1(validation, sent, len(classes)))
        spark.createDataFrame([(bytearray(net.packed()),)], "net binary").coalesce(1).write.mode("overwrite").parquet(f"{at}/epoch-{len(net.scores):05d}")
    best = load(stopped()[0])
    return export(best.layers(), best.mean, best.scale, classes), net
