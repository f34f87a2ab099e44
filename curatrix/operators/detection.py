"""Choosing among detector results (O-49, O-50, O-112, O-129, O-135)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.sources import pictures


def cascade(candidates: Sequence[tuple[str, Column]], expected: Column | None = None) -> tuple[Column, Column]:
    """O-49, O-112: (strategy, hands) of the first candidate with hands; the first candidate when all are empty."""
    found = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    name, hands = F.lit(candidates[0][0]), candidates[0][1]
    for tag, column in reversed(candidates):
        name, hands = F.when(found(column), tag).otherwise(name), F.when(found(column), column).otherwise(hands)
    return name, hands


def crop_override(full: Column, crop: Column, expected: Column) -> Column:
    """O-50: whether the crop's hands replace all others: enough of them, or more than a full frame that has too few."""
    n, m = F.coalesce(F.size(crop), F.lit(0)), F.coalesce(F.size(full), F.lit(0))
    return crop.isNotNull() & ((n >= expected) | ((m < expected) & (n > m)))


def detect(df: DataFrame, open_detectors: Callable[[], Sequence[tuple[str, Callable[[bytes], list | None]]]], content: str, schema: str) -> DataFrame:
    """O-135: runs detectors that each task opens once; one that fails to open is left out, one that fails on a row gives null.

    ``open_detectors`` returns (strategy, function) in cascade order; the first
    with hands ends the row's cascade. ``schema`` names the columns of ``df`` and
    then strategy and hands.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detectors = list(open_detectors())
        for part in parts:
            names, results = [], []
            for data in part[content]:
                name, hands = "error", None
                for tag, function in detectors:
                    try:
                        hands, name = function(data), tag
                    except Exception:  # a row's failure is its result
                        hands, name = None, "error"
                        continue
                    if hands:
                        break
                names.append(name)
                results.append(hands)
            yield part.assign(strategy=names, hands=results)

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class Strategy:
    """How a picture comes to a detector: its threshold, whether it is cut to its box, and a border of repeated edges as a share of the longer side."""

    name: str
    threshold: float
    cropped: bool = False
    padding: float | None = None

    def image(self, pixels: np.ndarray, box: Sequence[int] | None) -> np.ndarray | None:
        """The picture for the detector; None where a box is needed and there is none, or an empty one."""
        if self.cropped:
            if box is None:
                return None
            left, top, right, bottom = box
            pixels = pixels[max(top, 0) : bottom, max(left, 0) : right]
            if not pixels.size:
                return None
        if self.padding is not None:
            pixels = pictures.edge_padded(pixels, max(1, round(max(pixels.shape[:2]) * self.padding)))
        return pixels


def evaluate_strategies(df: DataFrame, strategies: Sequence[Strategy], open_detector: Callable[[float], Callable[[np.ndarray], int]], content: str = "content", box: str = "box") -> DataFrame:
    """O-112, O-129: a row for each row and strategy, with strategy, hands and error; one pass in which every picture is decoded once.

    Each task opens a detector for each threshold once. ``box`` holds (left, top, right, bottom) or null.
    A picture that cannot be decoded, or a detector that fails on it, gives an error and no hands; a strategy without its box gives neither.
    A row's results leave Python as one array, so its own columns are not repeated there.
    """
    plan = list(strategies)
    kinds = T.StructType.fromDDL("strategy string, hands int, error string")

    def evaluate(detectors: dict, data: bytes | None, corners: list | None) -> Iterator[tuple]:
        try:
            pixels, error = pictures.decode(data), None
        except Exception as fault:  # whatever a decoder raises is the row's result
            pixels, error = None, f"{type(fault).__name__}: {fault}"
        for s in plan:
            hands, fault = None, error
            if pixels is not None:
                try:
                    image = s.image(pixels, None if corners is None else [int(c) for c in corners])
                    hands = None if image is None else int(detectors[s.threshold](image))
                except Exception as failed:  # a row's failure is its result
                    fault = f"{type(failed).__name__}: {failed}"
            yield s.name, hands, fault

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detectors = {s.threshold: open_detector(s.threshold) for s in plan}
        for batch in batches:
            rows = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            found = [r for data, corners in rows for r in evaluate(detectors, data, corners)]
            flat = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 3, (pa.string(), pa.int32(), pa.string()), strict=True)]
            results = pa.ListArray.from_arrays(pa.array(range(0, len(found) + 1, len(plan) or 1) if found else [0] * (batch.num_rows + 1), pa.int32()), pa.StructArray.from_arrays(flat, names=kinds.names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], results], names=[f"c{k}" for k in range(batch.num_columns - 2)] + ["found"])

    # columns go by place, so names that clash are the caller's own
    given = df.select(*df.columns, F.col(content), F.col(box)).toDF(*(f"c{k}" for k in range(len(df.columns) + 2)))
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(df.schema)]).add("found", T.ArrayType(kinds))
    own = [F.col(f"c{k}").alias(name) for k, name in enumerate(df.columns)]
    return given.mapInArrow(run, schema).select(*own, F.inline("found"))
