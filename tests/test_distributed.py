"""Training over tables: the loss curve of a plain loop, whatever the partitions; stop and go on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.plans import distributed

CLASSES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 700)
    x = rng.normal(size=(700, 5)) + np.eye(5)[y] * 1.5
    x[:, 4] = 2.0
    return x, y, rng.random(700) + 0.5


def frame(spark, data, parts):
    x, y, w = data
    rows = [(f"k{i:04d}", x[i].tolist(), CLASSES[y[i]], float(w[i])) for i in range(len(y))]
    return spark.createDataFrame([*rows, ("odd", x[0].tolist(), "other", 1.0), ("none", None, "a", 1.0)], "k string, v array<double>, l string, w double").repartition(parts)


def table(spark, data, parts, group_rows=100):
    return distributed.prepared(frame(spark, data, parts), F.col("v"), F.col("l"), F.col("k"), CLASSES, F.col("w"), group_rows)


def plain(x, y, w, hidden, epochs, rate=1e-2, alpha=5e-4, seed=20260825):
    """Losses of a loop over all rows at once."""
    rng, sizes = np.random.default_rng(seed), [x.shape[1], *hidden, 3]
    params = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b))]
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1.0)
    m, v, losses = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], []
    for t in range(1, epochs + 1):
        acts = [z]
        for k in range(0, len(params), 2):
            h = acts[-1] @ params[k] + params[k + 1]
            acts.append(np.maximum(h, 0) if k < len(params) - 2 else h)
        p = np.exp(acts[-1] - acts[-1].max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(float(-(w * np.log(p[np.arange(len(y)), y])).sum() / w.sum()))
        d = (p - np.eye(3)[y]) * (w / w.sum())[:, None]
        grads = [None] * len(params)
        for k in range(len(params) - 2, -1, -2):
            grads[k], grads[k + 1] = acts[k // 2].T @ d + alpha * params[k] / len(y), d.sum(0)
            d = (d @ params[k].T) * (acts[k // 2] > 0)
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return losses


def test_losses_are_those_of_a_plain_loop_for_any_cut(spark, data, tmp_path):
    one, many = table(spark, data, 1), table(spark, data, 9)
    assert one.count() == 700
    runs = [distributed.train(t, t, CLASSES, f"file://{tmp_path}/{k}", (4,), epochs=3) for k, t in enumerate((one, many))]
    assert runs[0][1].losses == runs[1][1].losses and runs[0][0] == runs[1][0]
    assert runs[0][1].losses == pytest.approx(plain(*data, (4,), 3), rel=1e-9)
    # stopped after two epochs and gone on from there
    distributed.train(one, one, CLASSES, f"file://{tmp_path}/again", (4,), epochs=2)
    model, net = distributed.train(one, one, CLASSES, f"file://{tmp_path}/again", (4,), epochs=3)
    assert net.losses == runs[0][1].losses and model == runs[0][0]


def test_sums_run_through_the_tree(spark, data):
    x, _, w = data
    rows = table(spark, data, 3, group_rows=8)
    assert rows.agg(F.max("group")).first()[0] > 2 * distributed.FAN
    assert distributed.tree_sum(rows, lambda x, y, w: np.append((x * w[:, None]).sum(axis=0), len(x))) == pytest.approx([*(x * w[:, None]).sum(axis=0), 700])
    with pytest.raises(ValueError, match="no training rows"):
        distributed.started(rows.limit(0), 3, (4,), 1)
