"""Gradient-boosted trees in numpy with monotonic constraints, flattened for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    first: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.first:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row of features."""
        return _sigmoid(self.margin(x))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 80,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    min_child: float = 4.0,
) -> Forest:
    """Logistic boosting on histograms of quantile bins.

    ``monotone[f]`` is +1, -1 or 0: the margin never falls, never rises or is free
    as feature f grows. A split against the sign is not taken, and both sides of
    a taken one are bounded by its midpoint, so whole trees obey it. With one
    class or no rows the forest has no trees and gives the (smoothed) base rate.
    """
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    n, width = x.shape
    rate_1 = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate_1 / (1 - rate_1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1) if n else np.empty((0, width), dtype=np.int64)
    nodes: list[list[float]] = []
    first: list[int] = []
    margin = np.full(n, base)

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def score(g: float, h: float, w: float) -> float:
        return -(g * w + 0.5 * (h + l2) * w * w)

    def grow(rows: np.ndarray, level: int, low: float, high: float, grad: np.ndarray, hess: np.ndarray) -> int:
        me = len(nodes)
        g, h = float(grad[rows].sum()), float(hess[rows].sum())
        w = weight(g, h, low, high)
        nodes.append([0, np.inf, me, me, rate * w])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * min_child:
            for f in range(width):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(g - gl) / (h - hl + l2), low, high)
                gain = score(gl, hl, wl) + score(g - gl, h - hl, wr) - score(g, h, w)
                ok = (nl >= min_child) & (len(rows) - nl >= min_child) & ((wr - wl) * monotone[f] >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
        _, f, k, wl, wr = best
        if f >= 0:
            mid = (wl + wr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[f])]
            goes = binned[rows, f] <= k
            nodes[me][0], nodes[me][1] = f, cuts[f][k]
            nodes[me][2] = grow(rows[goes], level + 1, *bounds[0], grad, hess)
            nodes[me][3] = grow(rows[~goes], level + 1, *bounds[1], grad, hess)
        return me

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = _sigmoid(margin)
            first.append(len(nodes))
            grow(np.arange(n), 0, -np.inf, np.inf, p - y, np.maximum(p * (1 - p), 1e-9))
            part = _arrays(nodes, first[-1:], depth, 0.0)
            margin = margin + part.margin(x)
    return _arrays(nodes, first, depth, base)


def _arrays(nodes: list[list[float]], first: list[int], depth: int, base: float) -> Forest:
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(first, dtype=np.int64), depth, base)
