"""Scaling, dense networks, gates and arbitration (O-105..O-108)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaler_fit(df: DataFrame, vector: str) -> DataFrame:
    """O-105: (dim, mean, scale) with the population deviation; no variance gives scale 1.

    Sums and sums of squares around the first value would need a second pass;
    Spark's own stddev_pop merges partial moments instead.
    """
    each = df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return each.select("dim", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))


def scaled(vector: Column, mean: Sequence[float], scale: Sequence[float]) -> Column:
    """O-105: the vector under a fitted scaler."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, scale))
    return F.transform(vector, lambda v, i: (v - F.get(m, i)) / F.get(s, i))


def forward(model: dict, x: np.ndarray) -> np.ndarray:
    """O-106: class probabilities of rows of features."""
    h = (x - np.array(model["scaler"]["mean"])) / np.array(model["scaler"]["scale"])
    for layer in model["layers"]:
        h = h @ np.array(layer["weights"]) + np.array(layer["bias"])
        if layer["activation"] == "relu":
            h = np.maximum(h, 0.0)
        elif layer["activation"] == "softmax":
            e = np.exp(h - h.max(axis=1, keepdims=True))
            h = e / e.sum(axis=1, keepdims=True)
    return h


def mlp_score(df: DataFrame, vector: str, model: dict, out: str = "probabilities") -> DataFrame:
    """O-106: adds the probabilities by an Arrow-batched function; weights go out once by broadcast. A null or short vector gives null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    width = len(model["scaler"]["mean"])

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for part in parts:
            good = part.map(lambda v: v is not None and len(v) == width)
            rows: list = [None] * len(part)
            if good.any():
                found = forward(net, np.stack(part[good].tolist()).astype(np.float64))
                for at, p in zip(np.flatnonzero(good.to_numpy()), found, strict=True):
                    rows[at] = p
            yield pd.Series(rows, index=part.index, dtype=object)

    return df.withColumn(out, run(F.col(vector)))


def dense(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """O-106 for small layers: one expression for each output, inside generated code."""
    outs = []
    for o in range(len(bias)):
        total = F.lit(float(bias[o]))
        for i in range(len(weights)):
            total = total + F.get(x, F.lit(i)) * float(weights[i][o])
        outs.append(total)
    return F.array(*outs)


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def arg_max(probabilities: Column, classes: Sequence[str]) -> tuple[Column, Column]:
    """O-106: (class, confidence); the first of equal values wins."""
    top = F.array_max(probabilities)
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(probabilities, top).cast("int")), top


def gate(label: Column, confidence: Column, hands: Column, routes: dict[str, int], threshold: float) -> Column:
    """O-108: UNKNOWN unless confident enough (equal passes) and the hands are exactly the class's."""
    expected = F.create_map(*(F.lit(x) for kv in routes.items() for x in kv))[label]
    return F.when((confidence >= threshold) & (hands == expected), label).otherwise("UNKNOWN")


def arbitrate(df: DataFrame, key: str, classes: Sequence[str], routes: dict[str, int], threshold: float, frames: DataFrame | None = None) -> DataFrame:
    """O-107: (key, label, confidence, feature_hands) from hypothesis rows (key, feature_hands, probabilities).

    The most confident accepted hypothesis wins, the fewer-handed on a tie; with
    none, UNKNOWN with its own best probability. Keys of ``frames`` without any
    hypothesis get ('UNKNOWN', 1, 0). Two maxima in one aggregate, no window.
    """
    label, confidence = arg_max(F.col("probabilities"), classes)
    unknown = F.get("probabilities", F.lit(list(classes).index("UNKNOWN")))
    expected = F.create_map(*(F.lit(x) for kv in routes.items() for x in kv))[label]
    ok = (label != "UNKNOWN") & (confidence >= threshold) & (F.col("feature_hands") == expected)
    order = -F.col("feature_hands")
    best = lambda c, name, cond: F.max(F.when(cond, F.struct(c.alias("confidence"), order.alias("o"), name.alias("label"), F.col("feature_hands").alias("hands"))))
    rows = df.groupBy(key).agg(best(confidence, label, ok).alias("a"), best(unknown, F.lit("UNKNOWN"), F.lit(True)).alias("u"))
    picked = rows.select(key, F.coalesce("a", "u").alias("w")).select(key, "w.label", "w.confidence", F.col("w.hands").alias("feature_hands"))
    if frames is None:
        return picked
    return frames.select(key).distinct().join(picked, key, "left").fillna({"label": "UNKNOWN", "confidence": 1.0, "feature_hands": 0})
