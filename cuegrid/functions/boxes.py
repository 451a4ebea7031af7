"""Rectangles (x, y, w, h) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + k) for k in "xywh")


def overlap(a: Box, b: Box) -> Column:
    side = lambda p, q, n, m: F.greatest(F.lit(0), F.least(p + n, q + m) - F.greatest(p, q))
    return side(a[0], b[0], a[2], b[2]) * side(a[1], b[1], a[3], b[3])


def iou(a: Box, b: Box) -> Column:
    inter = overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def span_box(x: Column, w: Column, h: Column, chars: Column, start: Column, length: Column) -> tuple[Column, Column, Column]:
    """x, w and h of the characters from start on, by their share of the width of a line of ``chars``, 3 px at least."""
    n = F.greatest(F.lit(1), chars)
    left = x + F.rint(w * start / n).cast("int")
    right = x + F.rint(w * (start + length) / n).cast("int")
    return left, F.greatest(F.lit(3), right - left), F.greatest(F.lit(3), h)
