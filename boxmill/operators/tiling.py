"""Cutting images and their boxes into overlapping tiles.

Box tables here carry the image size: ``image_id, box_id, cls, x1, y1, x2, y2, width, height``. The tiles a box
touches follow from its coordinates by arithmetic, so cutting is one pass without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.functions import grids
from boxmill.functions.geometry import CORNERS, area, box_share, clamp01, clip, corners, corners_to_center, is_valid
from boxmill.functions.once import computed_once, exploded
from boxmill.operators.ranking import percentile_within

TILE_SIZE = 640
OVERLAP = 0.2
MIN_VISIBILITY = 0.3

TARGET_SHARE = 0.04
MIN_TILES = 1
MAX_TILES = 6
OVERLAP_FACTOR = 1.5
FALLBACK_OVERLAP = 0.2
SHARE_PERCENTILE = 0.1


def fixed_tiles(images: DataFrame, tile: int = TILE_SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Covering grid of every image: ``tile_id`` row-major, ``row, col, x1, y1, x2, y2`` (may pass the image edge)."""
    step = grids.tile_step(tile, overlap)
    w, h = F.col("width"), F.col("height")
    cols = grids.covering_count(w, tile, step)
    rows = grids.covering_count(h, tile, step)
    return (
        images.withColumn("n_cols", cols)
        .withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1)))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
        .withColumn("tile_id", F.col("row") * F.col("n_cols") + F.col("col"))
        .withColumn("x1", grids.covering_start(F.col("col"), w, tile, step))
        .withColumn("y1", grids.covering_start(F.col("row"), h, tile, step))
        .withColumn("x2", F.col("x1") + tile)
        .withColumn("y2", F.col("y1") + tile)
        .drop("n_cols")
    )


def _cut(boxes: DataFrame, cols: Column, rows: Column, start, tile_w: Column, tile_h: Column, step: Column) -> DataFrame:
    """Boxes times the tiles they overlap: adds ``tile_id, tx, ty`` and the clipped corners ``ix1 … iy2``."""
    x1, y1, x2, y2 = corners()
    w, h = F.col("width"), F.col("height")
    ends = dict(zip(("row_low_", "row_high_"), grids.touched_ends(y1, y2, rows, h, tile_h, step)))
    ends |= dict(zip(("col_low_", "col_high_"), grids.touched_ends(x1, x2, F.col("n_cols"), w, tile_w, step)))
    spread = boxes.withColumn("n_cols", cols).withColumns(ends)
    spread = exploded(exploded(spread, "row", "row_low_", "row_high_"), "col", "col_low_", "col_high_")
    spread = spread.withColumn("tx", start(F.col("col"), w, tile_w)).withColumn("ty", start(F.col("row"), h, tile_h))
    frame = [F.col("tx"), F.col("ty"), F.col("tx") + tile_w, F.col("ty") + tile_h]
    cut = [c.alias("i" + name) for c, name in zip(clip(corners(), frame), CORNERS)]
    found = spread.select("*", (F.col("row") * F.col("n_cols") + F.col("col")).alias("tile_id"), *cut)
    return computed_once(found, "tx", "ty", *(f"i{c}" for c in CORNERS)).filter(is_valid(_cut_box()))


def _cut_box() -> list[Column]:
    return [F.col("i" + c) for c in CORNERS]


def tile_box_overlaps(boxes: DataFrame, tile: int = TILE_SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Every pair of a box and a fixed tile that overlap, with the clipped corners and the visible share."""
    step = grids.tile_step(tile, overlap)
    w, h = F.col("width"), F.col("height")
    cut = _cut(
        boxes,
        grids.covering_count(w, tile, step),
        grids.covering_count(h, tile, step),
        lambda i, length, size: grids.covering_start(i, length, tile, step),
        F.lit(tile), F.lit(tile), F.lit(step),
    )
    whole = area(corners())
    return cut.withColumn("visible", F.when(whole > 0, area(_cut_box()) / whole))


def fixed_tile_boxes(
    boxes: DataFrame, tile: int = TILE_SIZE, overlap: float = OVERLAP, min_visibility: float = MIN_VISIBILITY,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Tile labels of the fixed grid: ``image_id, tile_id, box_id, cls``, the columns to ``carry``, ``xc, yc, bw, bh`` in tile coordinates.

    Drops boxes of which less than ``min_visibility`` is inside the tile; each value is clamped to [0, 1].
    """
    cut = tile_box_overlaps(boxes, tile, overlap).filter(F.col("visible").isNull() | (F.col("visible") >= min_visibility))
    x1, y1, x2, y2 = _cut_box()
    local = [x1 - F.col("tx"), y1 - F.col("ty"), x2 - F.col("tx"), y2 - F.col("ty")]
    center = [clamp01(c).alias(n) for c, n in zip(corners_to_center(local, F.lit(tile), F.lit(tile)), ("xc", "yc", "bw", "bh"))]
    return cut.select("image_id", "tile_id", "box_id", "cls", *carry, *center).filter((F.col("bw") > 0) & (F.col("bh") > 0))


def label_sizes(boxes: DataFrame) -> DataFrame:
    """Per image: ``share`` (10th percentile of box area / image area) and ``overlap_px`` (1.5 mean box side)."""
    x1, y1, x2, y2 = corners()
    shares = boxes.select("image_id", box_share(corners(), F.col("width"), F.col("height")).alias("nba"))
    share = percentile_within(shares, ["image_id"], "nba", SHARE_PERCENTILE, "share")
    sides = boxes.groupBy("image_id").agg(
        ((F.sum(x2 - x1) + F.sum(y2 - y1)) / (2 * F.count(F.lit(1))) * OVERLAP_FACTOR).cast("int").alias("overlap_px")
    )
    return share.join(sides, "image_id")


def adaptive_plan(
    images: DataFrame, boxes: DataFrame, tile: int = TILE_SIZE, target: float = TARGET_SHARE,
    min_tiles: int = MIN_TILES, max_tiles: int = MAX_TILES,
) -> DataFrame:
    """Images with ``share, n_tiles, overlap_px, tile_w, tile_h, step_x, step_y`` of their label-driven grid."""
    planned = images.join(label_sizes(boxes), "image_id", "left")
    n = grids.tiles_per_axis(F.col("share"), target, min_tiles, max_tiles)
    px = F.coalesce(F.col("overlap_px"), F.lit(int(tile * FALLBACK_OVERLAP)))
    whole = F.col("n_tiles") == 1
    step = F.greatest(F.lit(1), tile - F.col("overlap_px"))
    return (
        planned.withColumn("n_tiles", n)
        .withColumn("overlap_px", px)
        .withColumn("tile_w", F.when(whole, F.col("width")).otherwise(tile))
        .withColumn("tile_h", F.when(whole, F.col("height")).otherwise(tile))
        .withColumn("step_x", F.when(whole, F.col("width")).otherwise(step))
        .withColumn("step_y", F.when(whole, F.col("height")).otherwise(step))
    )


def _adaptive_counts() -> tuple[Column, Column]:
    return (
        grids.partial_count(F.col("width"), F.col("tile_w"), F.col("step_x")),
        grids.partial_count(F.col("height"), F.col("tile_h"), F.col("step_y")),
    )


def adaptive_tiles(plan: DataFrame) -> DataFrame:
    """Grid of every image of an ``adaptive_plan``.

    No tile is added at the edge, so a strip can stay uncovered; where the image is smaller than the tile the start
    is negative (``is_partial``) and labels refer to that start.
    """
    cols, rows = _adaptive_counts()
    return (
        plan.withColumn("n_cols", cols)
        .withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1)))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
        .withColumn("tile_id", F.col("row") * F.col("n_cols") + F.col("col"))
        .withColumn("x1", grids.partial_start(F.col("col"), F.col("width"), F.col("tile_w"), F.col("step_x")))
        .withColumn("y1", grids.partial_start(F.col("row"), F.col("height"), F.col("tile_h"), F.col("step_y")))
        .withColumn("x2", F.col("x1") + F.col("tile_w"))
        .withColumn("y2", F.col("y1") + F.col("tile_h"))
        .withColumn("is_partial", (F.col("x1") < 0) | (F.col("y1") < 0))
        .drop("n_cols")
    )


def adaptive_tile_boxes(plan: DataFrame, boxes: DataFrame) -> DataFrame:
    """Tile labels of the adaptive grid: no visibility rule, no clamp, sizes in (0, 1]."""
    sized = boxes.drop("width", "height", "split").join(
        plan.select("image_id", "width", "height", "tile_w", "tile_h", "step_x", "step_y"), "image_id"
    )
    cols, rows = _adaptive_counts()
    # Both axes have one step, except for a single whole-image tile, where the step does not matter.
    step = F.col("step_x")
    cut = _cut(
        sized, cols, rows, lambda i, length, size: grids.partial_start(i, length, size, step),
        F.col("tile_w"), F.col("tile_h"), step,
    )
    x1, y1, x2, y2 = _cut_box()
    local = [x1 - F.col("tx"), y1 - F.col("ty"), x2 - F.col("tx"), y2 - F.col("ty")]
    size_ok = F.col("bw").between(0, 1) & (F.col("bw") > 0) & F.col("bh").between(0, 1) & (F.col("bh") > 0)
    return cut.select(
        "image_id", "tile_id", "box_id", "cls", *corners_to_center(local, F.col("tile_w"), F.col("tile_h"))
    ).filter(size_ok)


def tiles_per_axis_stats(plan: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of the tiles per axis by split."""
    return plan.groupBy("split").agg(
        F.min("n_tiles").alias("min_tiles"), F.max("n_tiles").alias("max_tiles"), F.avg("n_tiles").alias("avg_tiles")
    )


def stitch(tile_boxes: DataFrame, tile: int = TILE_SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Tile labels back in image pixels (truncated); a box seen in two tiles stays twice.

    ``tile_boxes`` carry the image's ``width`` and ``height``, from which a tile's origin follows: no join, no shuffle.
    Boxes of tiles outside the grid are dropped.
    """
    origin = grids.covering_origin(F.col("tile_id"), F.col("width"), F.col("height"), tile, overlap)
    placed = tile_boxes.select("*", *origin).filter("tx IS NOT NULL")
    xc, yc, bw, bh, tx, ty = (F.col(c) for c in ("xc", "yc", "bw", "bh", "tx", "ty"))
    exact = [(xc - bw / 2) * tile + tx, (yc - bh / 2) * tile + ty, (xc + bw / 2) * tile + tx, (yc + bh / 2) * tile + ty]
    return placed.select(
        "image_id", "tile_id", "box_id", "cls", *[c.cast("int").alias(n) for c, n in zip(exact, CORNERS)]
    )


def check_stored_tiles(grid: DataFrame, stored: DataFrame) -> DataFrame:
    """The grid tiles, failing the job on a tile of the grid that is not stored."""
    present = stored.select("image_id", "tile_id").distinct().withColumn("stored", F.lit(True))
    missing = F.format_string("tile %s of image %s is missing", F.col("tile_id").cast("string"), F.col("image_id").cast("string"))
    tested = grid.join(present, ["image_id", "tile_id"], "left")
    found = F.when(F.col("stored"), F.lit(True)).otherwise(F.raise_error(missing).cast("boolean"))
    return tested.filter(found).drop("stored")


def stitched_totals(grid: DataFrame, tile_boxes: DataFrame) -> DataFrame:
    """Per image: grid rows and columns, tiles, and labels over all tiles (copies counted)."""
    counts = tile_boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_boxes"))
    shape = grid.groupBy("image_id").agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count(F.lit(1)).alias("n_tiles")
    )
    return shape.join(counts, "image_id", "left").na.fill(0, ["n_boxes"])
