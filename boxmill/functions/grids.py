"""Tile grids in closed form: tile starts follow from an index, so no grid table has to be joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_step(tile: int, overlap: float) -> int:
    """Distance between neighbouring tile starts for an overlap given as a ratio."""
    return max(1, int(tile * (1.0 - overlap)))


def covering_count(length: Column, tile: int, step: int) -> Column:
    """Number of tiles that cover ``length`` completely, the last one moved back onto the edge."""
    return F.when(length <= tile, F.lit(1)).otherwise(F.ceil((length - tile) / step).cast("int") + 1)


def covering_start(index: Column, length: Column, tile: int, step: int) -> Column:
    """Start of tile ``index`` in a covering grid."""
    return F.greatest(F.lit(0), F.least(index * step, length - tile))


def covering_origin(tile_id: Column, width: Column, height: Column, tile: int, overlap: float) -> list[Column]:
    """``tx, ty``: start of a row-major tile of a covering grid; null for a number outside the grid."""
    step = tile_step(tile, overlap)
    cols, rows = covering_count(width, tile, step), covering_count(height, tile, step)
    row = F.floor(tile_id / cols).cast("int")
    inside = (tile_id >= 0) & (row < rows)
    starts = covering_start(tile_id % cols, width, tile, step), covering_start(row, height, tile, step)
    return [F.when(inside, s).alias(name) for s, name in zip(starts, ("tx", "ty"))]


def tile_starts(length: Column, tile: int, overlap: float) -> Column:
    """All starts of a covering grid as an array."""
    step = tile_step(tile, overlap)
    last = covering_count(length, tile, step) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: covering_start(i, length, tile, step))


def touched_ends(low: Column, high: Column, count: Column, length: Column, tile: Column, step: Column) -> tuple[Column, Column]:
    """First and last index of the tiles that can overlap the interval (low, high): a superset by at most one on each side.

    Works for any grid whose start is ``min(i*step, length-tile)``; the exact test is left to the clip.
    """
    last = count - 1
    first = F.greatest(F.lit(0), F.least(last, F.floor((low - tile) / step).cast("int")))
    final = F.when(high > length - tile, last).otherwise(
        F.least(last, F.greatest(F.lit(0), F.floor(high / step).cast("int")))
    )
    return first, F.greatest(first, final)


def tiles_per_axis(share: Column, target: float, min_tiles: int, max_tiles: int) -> Column:
    """Tiles per axis that bring a box share up to ``target``; the minimum when there is no share."""
    wanted = F.ceil(F.sqrt(F.lit(target) / share)).cast("int")
    return F.when(share.isNull() | (share <= 0), F.lit(min_tiles)).otherwise(
        F.greatest(F.lit(min_tiles), F.least(wanted, F.lit(max_tiles)))
    )


def partial_count(length: Column, tile: Column, step: Column) -> Column:
    """Number of tiles of a grid without an extra edge tile (a right or bottom strip may stay uncovered)."""
    return F.greatest(F.lit(1), F.floor((length - tile) / step).cast("int") + 1)


def partial_start(index: Column, length: Column, tile: Column, step: Column) -> Column:
    """Start of tile ``index`` in such a grid; negative when the image is smaller than the tile."""
    return F.least(index * step, length - tile)
