"""Quality classifier: naive Bayes support vectors over word n-gram indicators.

Tokens are runs of letters and digits (any byte beyond ASCII is a letter) and
runs of other marks, case kept; a token that repeats the one before it becomes
"again". An indicator stands for a hashed n-gram (one to three tokens, ``WIDTH``
cells) that takes at least a certain share of the text's n-grams; each n-gram
has one for each of the ``LEVELS``, the lowest being mere presence. Indicators
are scaled by the log ratio of their smoothed counts in the two classes, and a
linear hinge-loss model is fitted to them by dual coordinate descent. Margins
become scores by a logistic fit to out-of-fold margins. Whole texts are scored.

``max_rows`` labelled rows of the training side fit the model: those whose
hashed id is under a threshold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import id_crc, slices, table, text_bytes
from curatrix.llm.quality_rules import training_rows

LEVELS = (0.0, 0.02, 0.1)
SIZES = (1, 2, 3)
WIDTH = 1 << 20
AGAIN = 7
_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\xff]+")
#: Odd multipliers of the n-gram hash, one for each place.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct indicator numbers of a text."""
    tokens = np.array([zlib.crc32(t) for t in _TOKENS.findall(text)], dtype=np.uint64)
    if not len(tokens):
        return np.empty(0, dtype=np.int64)
    again = tokens[1:] == tokens[:-1]
    tokens[1:][again] = AGAIN
    found = []
    for size in SIZES:
        n = len(tokens) - size + 1
        if n < 1:
            break
        mixed = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            mixed = (mixed ^ tokens[k : k + n]) * np.uint64(_MIX[k])
            mixed ^= mixed >> np.uint64(29)
        cell, count = np.unique((mixed >> np.uint64(44)).astype(np.int64), return_counts=True)
        found += [cell[count >= max(least * n, 1)] * len(LEVELS) + level for level, least in enumerate(LEVELS)]
    return np.unique(np.concatenate(found))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 5) -> np.ndarray:
    """Weights (bias last) of the L1-loss linear support vector machine; y is -1 or 1.

    ``rows`` are the indices of each row's indicators, whose values are ``scale``
    at those indices; every row has a bias of 1 beside them.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([scale[i] @ scale[i] + 1.0 for i in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            i = rows[k]
            v = scale[i]
            g = y[k] * (w[i] @ v + bias) - 1
            new = min(max(alpha[k] - g / norm[k], 0.0), cost[k])
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * y[k] * v
                bias += (new - alpha[k]) * y[k]
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-4:
            break
    return np.append(w, bias)


@dataclass
class Linear:
    """Weights of the sorted indicator numbers, a bias, and the logistic map of margins."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        if not len(self.numbers):
            return self.bias
        at = np.minimum(np.searchsorted(self.numbers, features), len(self.numbers) - 1)
        return float(self.weights[at[self.numbers[at] == features]].sum() + self.bias)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def _train(x: list[np.ndarray], y: np.ndarray, smooth: float, cost: float, least: int) -> Linear:
    """``x``: the rows' sorted indicator numbers. Those in fewer than ``least`` rows are left out."""
    flat = np.concatenate([np.empty(0, dtype=np.int32), *x])
    seen = np.bincount(flat, minlength=WIDTH * len(LEVELS))
    number = np.flatnonzero(seen >= least)
    index = np.full(len(seen), -1, dtype=np.int32)
    index[number] = np.arange(len(number))
    rows = [k[k >= 0] for k in (index[f] for f in x)]
    p, q = (smooth + np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *(r for r, of in zip(rows, side, strict=True) if of)]), minlength=len(number)) for side in (y > 0, y < 0))
    ratio = np.log((p / p.sum()) / (q / q.sum())) if len(number) else np.empty(0)
    n_pos = max(int((y > 0).sum()), 1)
    n_neg = max(int((y < 0).sum()), 1)
    costs = np.where(y > 0, cost * len(y) / (2 * n_pos), cost * len(y) / (2 * n_neg))
    w = dual_coordinate_descent(rows, ratio, y, costs)
    return Linear(number, w[:-1] * ratio, float(w[-1]), 1.0, 0.0)


def _logistic(margin: np.ndarray, good: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (positive) and shift of P(good | margin), by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d = p - good
        h = np.maximum(p * (1 - p), 1e-6)
        g = np.array([d @ margin + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
        m = np.array([[h @ margin**2 + 1e-2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-2 + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = max(a - np.clip(step[0], -1, 1), 1e-3), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, smooth: float = 1.0, cost: float = 0.1, least: int = 3, folds: int = 3) -> Linear:
    """The model of P(label = 1). One class alone, or no rows, gives a constant score: the smoothed share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["_id", "y", "x"])

    rows = training_rows(docs, labels, label, max_rows).mapInArrow(run, "_id long, y double, x binary").toArrow().sort_by("_id")
    x = [np.frombuffer(b.as_buffer() or b"", dtype="<i4") for b in rows["x"]]
    y = np.where(rows["y"].to_numpy() > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Linear(np.empty(0, dtype=np.int64), np.empty(0), float(np.log(share / (1 - share))), 1.0, 0.0)
    model = _train(x, y, smooth, cost, least)
    fold = np.arange(len(y)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        part = _train([x[i] for i in inside], y[inside], smooth, cost, least)
        for i in np.flatnonzero(fold == k):
            margin[i] = part.margin(x[i])
    model.slope, model.shift = _logistic(margin, (y > 0).astype(np.float64))
    return model


def score(docs: DataFrame, model: Linear, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; a null or empty text has no indicators, so the bias decides.

    Ids may be null or repeat, each row keeps its own; other columns are not read.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            s = model.score(np.array([model.margin(features(t)) for t in batch.column(1).to_pylist()], dtype=np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def op6_nbsvm_quality(spark, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score", "predicted")
