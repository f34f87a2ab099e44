"""Toxicity by non-negative positive-unlabelled learning in numpy.

The positives are confirmed toxic texts; the unlabelled texts are a sample of
the labelled rows of the training side whose labels are not read (toxic ones
among them, at their natural rate). With the class prior p, the risk of a
scorer g under the logistic loss is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)])

and where the bracket is negative, the step ascends it instead. The scorer is
linear over hashed features: every word (A-Z lower-cased, cut at ASCII
punctuation) and its beginnings of ``STEMS`` bytes, ``WIDTH`` cells in all. A
feature's value is its share of the text's words in percent, at most ``CAP``,
times a scale: how many standard errors its count among the positives is off
what the unlabelled texts make one expect. The scale shrinks cells that tell
nothing; none is left out but those in fewer than ``least`` sampled texts.

Bounds, both on labelled rows: ``max_positive`` and ``max_unlabelled`` fit the
model. The class prior is the share of toxic rows among all labelled rows of
the training side. Whole texts are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import durable, hash_sample, id_crc, slices, table, text_bytes, texts_of

_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
WIDTH = 1 << 18
STEMS = (4, 6)
CAP = 2.0
#: Words that a task remembers.
CACHE = 500_000


class Hasher:
    """Turns texts into sparse rows of hashed word features; remembers words seen before."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.cells = np.empty((1024, 1 + len(STEMS)), dtype=np.int64)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        at = len(self.known)
        while at + len(new) > len(self.cells):
            self.cells = np.concatenate([self.cells, np.empty_like(self.cells)])
        for k, w in enumerate(new, at):
            self.known[w] = k
            self.cells[k, 0] = zlib.crc32(w) % WIDTH
            for j, size in enumerate(STEMS, 1):
                self.cells[k, j] = zlib.crc32(w[:size] + b"*") % WIDTH if len(w) > size else -1

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, value) of the texts' features, by row and then by cell."""
        words = [t.lower().translate(_WORDS).split() for t in texts]
        every = set().union(*words)
        if not self.known.keys() >= every:
            self._learn(every)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.fromiter((self.known[w] for part in words for w in part), dtype=np.int64, count=int(sizes.sum()))
        cells = self.cells[flat]
        keys = (np.repeat(np.arange(len(texts)), sizes)[:, None] * WIDTH + cells)[cells >= 0]
        found, n = np.unique(keys, return_counts=True)
        row, cell = np.divmod(found, WIDTH)
        return row, cell, np.minimum(100.0 * n / sizes[row], CAP)


@dataclass
class Scorer:
    """A weight for each cell, the scale taken in, and the margin of a text without any feature."""

    weights: np.ndarray
    bias: float

    def margins(self, hasher: Hasher, texts: list[bytes]) -> np.ndarray:
        row, cell, value = hasher.rows(texts)
        return np.bincount(row, value * self.weights[cell], minlength=len(texts)) + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Sparse:
    """Rows of (cell, value); ``row`` ascends."""

    row: np.ndarray
    cell: np.ndarray
    value: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.cell], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.cell, self.value * g[self.row], minlength=width)


def risk(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part and the bracket of the risk, of margins under the logistic loss."""
    positive = prior * np.logaddexp(0, -pos).mean()
    return float(positive), float(np.logaddexp(0, unl).mean() - prior * np.logaddexp(0, pos).mean())


def fit_nnpu(pos: Sparse, unl: Sparse, width: int, prior: float, steps: int = 150, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk, by Adam on all rows."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = -1.0
    for step in range(1, steps + 1):
        gp, gu = pos.dot(w[:-1]) + w[-1], unl.dot(w[:-1]) + w[-1]
        sp, su = _sigmoid(gp), _sigmoid(gu)
        of_negative = (-prior * sp / pos.n, su / unl.n)
        if risk(gp, gu, prior)[1] >= 0:
            cp, cu = of_negative[0] - prior * (1 - sp) / pos.n, of_negative[1]
        else:
            cp, cu = -of_negative[0], -of_negative[1]
        grad = np.append(pos.back(cp, width) + unl.back(cu, width) + l2 * w[:-1], cp.sum() + cu.sum())
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def scales(pos: Sparse, unl: Sparse, least: int) -> np.ndarray:
    """Each cell's scale: a third of its standard errors; nought where fewer than ``least`` texts have it."""
    in_pos, in_unl = np.bincount(pos.cell, minlength=WIDTH), np.bincount(unl.cell, minlength=WIDTH)
    expected = pos.n * in_unl / max(unl.n, 1)
    return np.where(in_pos + in_unl >= least, np.abs(in_pos - expected) / np.sqrt(expected + 1) / 3, 0.0)


def sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(_id, kind, text) of positives (kind 1) and unlabelled (kind 0), and the class prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull()).where(id_crc("_id") % 3 != 1)
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    share = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("_y").cast("long")), F.lit(0)).alias("k")).first()
    prior = (share["k"] + 0.5) / (share["n"] + 10)
    positive = hash_sample(known.where(F.col("_y") == 1).select("_id"), max_positive).withColumn("kind", F.lit(1))
    unlabelled = hash_sample(known.select("_id"), max_unlabelled).withColumn("kind", F.lit(0))
    return texts_of(docs, positive.unionByName(unlabelled)), prior


def _rows(texts: DataFrame) -> dict[int, Sparse]:
    """The sampled texts' features by kind, rows in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches):
            row, cell, value = hasher.rows(batch.column(2).to_pylist())
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(cell.astype("<i4")), pack(value.astype("<f4"))], names=["_id", "kind", "cell", "value"])

    found = texts.select("_id", "kind", "text").mapInArrow(run, "_id long, kind int, cell binary, value binary").toArrow().sort_by([("kind", "ascending"), ("_id", "ascending")])
    out = {}
    for kind in (0, 1):
        part = found.filter(pc.equal(found["kind"], kind))
        cells = [np.frombuffer(b, dtype="<i4") for b in part["cell"].to_pylist()]
        values = [np.frombuffer(b, dtype="<f4") for b in part["value"].to_pylist()]
        row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        out[kind] = Sparse(row, np.concatenate([np.empty(0, "<i4"), *cells]), np.concatenate([np.empty(0, "<f4"), *values]).astype(np.float64), len(cells))
    return out


def learn(pos: Sparse, unl: Sparse, prior: float, least: int = 5) -> Scorer:
    """The scorer of hashed rows; without positives or unlabelled rows every text gets the prior."""
    if not pos.n or not unl.n:
        return Scorer(np.zeros(WIDTH), float(np.log(prior / (1 - prior))))
    scale = scales(pos, unl, least)
    cells = np.flatnonzero(scale)
    index = np.full(WIDTH, -1)
    index[cells] = np.arange(len(cells))

    def narrow(x: Sparse) -> Sparse:
        good = index[x.cell] >= 0
        return Sparse(x.row[good], index[x.cell[good]], x.value[good] * scale[x.cell[good]], x.n)

    w, bias = fit_nnpu(narrow(pos), narrow(unl), len(cells), prior)
    weights = np.zeros(WIDTH)
    weights[cells] = w * scale[cells]
    return Scorer(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 6000) -> Scorer:
    """Learns from rows whose crc32(doc_id as text) mod 3 is not 1; labels of other rows are not read.

    Ids that repeat in ``docs`` give one text each, so both bounds hold on rows.
    """
    texts, prior = sample(docs, labels, max_positive, max_unlabelled)
    found = _rows(durable(texts))
    return learn(found[1], found[0], prior)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; a null text counts as empty.

    Ids may be null or repeat, each row keeps its own; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches):
            s = _sigmoid(shared.value.margins(hasher, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def op1_nnpu_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score", "predicted")
