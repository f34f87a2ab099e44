"""Boxes, crops, borders and grids as expressions (O-14, O-39, O-98..O-100, O-136)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    """Half-even rounding to an integer."""
    return F.bround(c).cast("int")


def valid_box(box: Column, width: Column, height: Column) -> Column:
    """O-39: corners in order and inside the frame; a missing box is invalid, a missing number is 0."""
    x0, y0, x1, y1 = (F.coalesce(box[k], F.lit(0.0)) for k in ("xmin", "ymin", "xmax", "ymax"))
    inside = (x0 >= 0) & (x0 < x1) & (x1 <= width) & (y0 >= 0) & (y0 < y1) & (y1 <= height)
    return box.isNotNull() & F.coalesce(inside, F.lit(False))


def annotation_crop(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column, margin: float, least: int = 32) -> Column:
    """O-98: square (left, top, right, bottom) around a box, widened by the margin, cut to the frame.

    Null for an empty box or a result under ``least`` pixels either way.
    """
    w, h = xmax - xmin, ymax - ymin
    half = F.greatest(w, h) * (1 + 2 * margin) / 2
    cx, cy = (xmin + xmax) / 2, (ymin + ymax) / 2
    left, top = F.greatest(F.lit(0), _int(cx - half)), F.greatest(F.lit(0), _int(cy - half))
    right, bottom = F.least(width.cast("int"), _int(cx + half)), F.least(height.cast("int"), _int(cy + half))
    good = (w > 0) & (h > 0) & (right - left >= least) & (bottom - top >= least)
    return F.when(good, F.array(left, top, right, bottom))


def border(width: Column, height: Column, ratio: float) -> Column:
    """O-99: padding border in pixels, one at least."""
    return F.greatest(F.lit(1), _int(F.greatest(width, height) * ratio))


def clamped_crop(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, grow: float = 1.8, share: float = 0.35) -> Column:
    """O-100: square of ``grow`` times the longer side, at least ``share`` of the shorter frame side, moved inside."""
    side = F.greatest(F.greatest(right - left, bottom - top) * grow, F.least(width, height) * share)
    side = F.least(side, width, height)
    x = F.least(F.greatest((left + right) / 2 - side / 2, F.lit(0.0)), width - side)
    y = F.least(F.greatest((top + bottom) / 2 - side / 2, F.lit(0.0)), height - side)
    return F.array(_int(x), _int(y), _int(x + side), _int(y + side))


def grid_place(index: Column, columns: int = 7) -> Column:
    """O-14: (column, row) of the index-th cell, from 0."""
    return F.struct((index % columns).alias("column"), F.floor(index / columns).alias("row"))


def clamp_index(i: Column, pad: Column | int, n: Column) -> Column:
    """O-136: source index of padded index i when edges are repeated."""
    return F.least(F.greatest(i - pad, F.lit(0)), n - 1)
