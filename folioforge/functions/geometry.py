"""Boxes on pages as Column expressions. A box is four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def overlap_ratio(a: Box, b: Box) -> Column:
    """Share of a's area that b covers; 0 for an empty box."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def x_overlap(a: Box, b: Box) -> Column:
    """Common width over the narrower width."""
    narrow = F.least(a[2] - a[0], b[2] - b[0])
    return F.when(narrow > 0, F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) / narrow).otherwise(0.0)


def contains(outer: Box, inner: Box) -> Column:
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def padded(b: Box, width: Column, height: Column, by: float = 5.0) -> Box:
    """A table's zone: its box with a margin, inside the page."""
    return (F.greatest(F.lit(0.0), b[0] - by), F.greatest(F.lit(0.0), b[1] - by), F.least(width, b[2] + by), F.least(height, b[3] + by))


def normalise(b: Box, width: Column, height: Column, rotation: Column, bottom_up: Column) -> Box:
    """Top-left origin, rotation by quarter turns undone, clamped to the page, corners in order."""
    x0, y0, x1, y1 = b
    y0, y1 = F.when(bottom_up, height - y1).otherwise(y0), F.when(bottom_up, height - y0).otherwise(y1)

    def pick(a0, a90, a180, a270):
        return F.when(rotation == 90, a90).when(rotation == 180, a180).when(rotation == 270, a270).otherwise(a0)

    r0, r1 = pick(x0, y0, width - x1, height - y1), pick(x1, y1, width - x0, height - y0)
    s0, s1 = pick(y0, width - x1, height - y1, x0), pick(y1, width - x0, height - y0, x1)
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    r0, r1, s0, s1 = clamp(r0, width), clamp(r1, width), clamp(s0, height), clamp(s1, height)
    return (F.least(r0, r1), F.least(s0, s1), F.greatest(r0, r1), F.greatest(s0, s1))
