"""Grids of cells, one for a few size levels, that spread the boxes of one image over many join keys.

A box has the level of its longer side: the smallest power of two (at least 64 pixels) that is as long. Levels share a grid by threes, as
each grid on which a box lies is a row to move; a grid is named by its coarsest level. Two boxes that
overlap enough differ by few levels, and meet on the grid of the higher one: one side waits in the cell of its centre, on the
grids of its level and those above; the other looks around on the same grids, where its reach is a few cells whatever
the sizes. So a huge box among small ones costs no more rows than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.functions.geometry import is_valid
from boxmill.functions.once import exploded

FINEST = 6
COARSEST = 40
# Coordinates beyond this, infinite and NaN ones included, belong to no picture; such boxes meet nothing.
FARTHEST = float(1 << (COARSEST - 1))
# Covers rounding in the reach, in pixels.
SLACK = 0.01

CELL = ("cell_level_", "cell_x_", "cell_y_")
# Levels that share a grid.
GRID_LEVELS = 3
# The level of boxes that have no place on any grid.
NOWHERE = FINEST - GRID_LEVELS
# The side of a cell in units of its grid's longest side. Wide cells mean that few rows lie in two of them.
CELL_SIDES = 2


def placeable(box: Sequence[Column]) -> Column:
    """True for boxes that can overlap another one: of positive area and within the coordinate range."""
    near = reduce(Column.__and__, [(c > -FARTHEST) & (c < FARTHEST) for c in box])
    return is_valid(box) & near


def centre_reach(min_iou: float) -> float:
    """How far the centres of two boxes with an IoU of at least ``min_iou`` (> 0) can be apart, in sides of either box.

    Each side of the intersection is at least ``min_iou`` times that side of either box. So one box is at most 1/min_iou
    times as wide as the other, and the centres differ by at most (w + w')/2 - min_iou * max(w, w').
    """
    return max(1.0 - min_iou, 0.5 / min_iou - 0.5)


def level_of(box: Sequence[Column]) -> Column:
    """Bit length of the longer side, rounded up, less one: the exponent of the power of two that covers it."""
    return _level(_longer(box))


def _longer(box: Sequence[Column]) -> Column:
    x1, y1, x2, y2 = box
    return F.greatest(x2 - x1, y2 - y1)


def _level(side: Column) -> Column:
    return F.greatest(F.lit(FINEST), F.length(F.bin(F.ceil(side) - 1)))


def grid_level(level: Column) -> Column:
    """The grid of a level: the coarsest one that shares it."""
    return (level + (GRID_LEVELS - 1) - F.pmod(level - FINEST, F.lit(GRID_LEVELS))).cast("int")


def partner_levels(box: Sequence[Column], min_iou: float) -> tuple[Column, Column]:
    """The lowest and the highest level of boxes that can have an IoU of at least ``min_iou``; 0 stands for any overlap at all."""
    if min_iou <= 0:
        return F.lit(FINEST), F.lit(COARSEST)
    # The factors cover rounding in the IoU.
    low, high = _level(_longer(box) * (min_iou * (1 - 1e-9))), _level(_longer(box) * ((1 + 1e-9) / min_iou))
    return low, F.greatest(level_of(box), F.least(high, F.lit(COARSEST)))


def reach(box: Sequence[Column], level: Column, min_iou: float) -> list[Column]:
    """How far from a box's centre, in x and y, that of a partner of the given level can be."""
    x1, y1, x2, y2 = box
    sides = (x2 - x1, y2 - y1)
    far = [(s + F.pow(F.lit(2.0), level)) / 2 + SLACK for s in sides]
    return [F.least(f, s * centre_reach(min_iou) + SLACK) for f, s in zip(far, sides)] if min_iou > 0 else far


def centre_cell(box: Sequence[Column], level: Column, sides: int) -> tuple[Column, Column]:
    """``x, y`` of the cell of one level in which the centre lies."""
    x1, y1, x2, y2 = box
    side = F.pow(F.lit(2.0), level) * sides
    return F.floor((x1 + x2) / 2 / side), F.floor((y1 + y2) / 2 / side)


def in_cells(
    df: DataFrame, box: Sequence[Column], low: Column, high: Column, far: Callable[[Column], Sequence[Column]], sides: int, elsewhere: Column | None = None
) -> DataFrame:
    """A row for each cell, as the columns ``CELL``, on the grids of the levels ``low`` to ``high`` within ``far(level)`` of a box's centre.

    With ``elsewhere``, a box of the level ``NOWHERE`` has one row, in the cell of that number.
    """
    level, x, y = CELL
    levels = exploded(df.withColumns({"low_": grid_level(low), "high_": grid_level(high)}), level, "low_", "high_", GRID_LEVELS)
    x1, y1, x2, y2 = box
    side = F.pow(F.lit(2.0), F.col(level)) * sides
    ends = {}
    for name, c, r in zip((x, y), ((x1 + x2) / 2, (y1 + y2) / 2), far(F.col(level))):
        low_high = F.floor((c - r) / side), F.floor((c + r) / side)
        if elsewhere is not None:
            low_high = (F.when(F.col(level) >= FINEST, end).otherwise(elsewhere) for end in low_high)
        ends |= dict(zip((f"{name}low_", f"{name}high_"), low_high))
    return exploded(exploded(levels.withColumns(ends), x, f"{x}low_", f"{x}high_"), y, f"{y}low_", f"{y}high_")


def _spread(df: DataFrame, box: Sequence[Column], min_iou: float, far: Callable[[Column], Sequence[Column]], level: str) -> DataFrame:
    placed = df.where(placeable(box)).withColumn(level, grid_level(level_of(box)))
    return in_cells(placed, box, F.col(level), partner_levels(box, min_iou)[1], far, CELL_SIDES)


def searching(df: DataFrame, box: Sequence[Column], min_iou: float) -> DataFrame:
    """One side of a meeting: rows in all cells where a partner can wait, with their own ``search_level``."""
    return _spread(df, box, min_iou, lambda n: reach(box, n, min_iou), "search_level")


def waiting(df: DataFrame, box: Sequence[Column], min_iou: float) -> DataFrame:
    """The other side: rows in the cell of their centre, on the grids of their ``wait_level`` and above."""
    return _spread(df, box, min_iou, lambda _: (F.lit(0.0), F.lit(0.0)), "wait_level")


def meet_once(search_level: Column, wait_level: Column, cell_level: Column) -> Column:
    """True on the one grid where a pair is to meet: that of its higher level."""
    return cell_level == F.greatest(search_level, wait_level)
