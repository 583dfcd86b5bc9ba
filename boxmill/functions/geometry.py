"""Box arithmetic as Column expressions. Boxes are four columns (x1, y1, x2, y2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def corners(source: Column | None = None) -> list[Column]:
    """The four corner columns, of the row or of a struct column."""
    if source is None:
        return [F.col(c) for c in CORNERS]
    return [source[c] for c in CORNERS]


def center_to_corners(xc: Column, yc: Column, bw: Column, bh: Column, width: Column, height: Column) -> list[Column]:
    """Normalised centre box to float pixel corners."""
    return [
        (xc * width - bw * width / 2).alias("x1"),
        (yc * height - bh * height / 2).alias("y1"),
        (xc * width + bw * width / 2).alias("x2"),
        (yc * height + bh * height / 2).alias("y2"),
    ]


def center_to_int_corners(xc: Column, yc: Column, bw: Column, bh: Column, width: Column, height: Column) -> list[Column]:
    """Normalised centre box to integer pixel corners, truncated toward zero."""
    exact = [(xc - bw / 2) * width, (yc - bh / 2) * height, (xc + bw / 2) * width, (yc + bh / 2) * height]
    return [c.cast("int").alias(name) for c, name in zip(exact, CORNERS)]


def corners_to_center(box: Sequence[Column], width: Column, height: Column) -> list[Column]:
    """Pixel corners to normalised centre box."""
    x1, y1, x2, y2 = box
    return [
        ((x1 + x2) / 2.0 / width).alias("xc"),
        ((y1 + y2) / 2.0 / height).alias("yc"),
        ((x2 - x1) / width).alias("bw"),
        ((y2 - y1) / height).alias("bh"),
    ]


def clamp01(value: Column) -> Column:
    """Clamp one value to [0, 1]; null stays null (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def is_valid(box: Sequence[Column]) -> Column:
    """True for a box with positive width and height."""
    x1, y1, x2, y2 = box
    return (x2 > x1) & (y2 > y1)


def ordered_corners(points: Column) -> list[Column]:
    """Corners from an array of exactly two [x, y] points in any order; null for any other count."""
    first, second = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    ax, ay, bx, by = (F.get(p, F.lit(i)) for p in (first, second) for i in (0, 1))
    two = F.size(points) == 2
    values = [F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)]
    return [F.when(two, v).alias(name) for v, name in zip(values, CORNERS)]


def clip(box: Sequence[Column], frame: Sequence[Column]) -> list[Column]:
    """Intersection of a box with a frame; empty when the result is not ``is_valid``."""
    return [
        F.greatest(box[0], frame[0]),
        F.greatest(box[1], frame[1]),
        F.least(box[2], frame[2]),
        F.least(box[3], frame[3]),
    ]


def area(box: Sequence[Column]) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def box_share(box: Sequence[Column], width: Column, height: Column) -> Column:
    """Box area as a share of the image area."""
    return area(box) / (width * height)


def shift(box: Sequence[Column], dx: Column, dy: Column) -> list[Column]:
    """Tile coordinates to image coordinates."""
    return [(c + d).alias(name) for c, d, name in zip(box, (dx, dy, dx, dy), CORNERS)]


def overlaps(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """True when the two boxes share a positive area."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union, sides clamped at 0, union at least 1e-9; null if a box is null."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(
        zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    )
    areas = [F.greatest(zero, c[2] - c[0]) * F.greatest(zero, c[3] - c[1]) for c in (a, b)]
    known = a[0].isNotNull() & b[0].isNotNull()
    return F.when(known, inter / F.greatest(areas[0] + areas[1] - inter, F.lit(1e-9)))


def int_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of integer boxes: 0 without intersection, no floor on the union."""
    zero = F.lit(0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(
        zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    )
    known = a[0].isNotNull() & b[0].isNotNull()
    return F.when(known & (inter == 0), F.lit(0.0)).when(known, inter / (area(a) + area(b) - inter))
