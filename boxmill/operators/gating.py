"""The tile gate: which tiles go to the detector, and what that costs in recall.

Tile scores: ``image_id, tile_id, prob, label`` (label 1 = the tile has an object).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.functions import grids
from boxmill.functions.geometry import CORNERS, corners, shift
from boxmill.operators.ranking import top_rows
from boxmill.operators.tiling import OVERLAP, TILE_SIZE

# The thresholds of the sweep.
SWEEP = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
TILE_THRESHOLD = 0.5
TOP_K = 2


def ratio(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    """``part / whole``, or ``default`` where the divisor is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(default).cast("double"))


def kept_tiles(scores: DataFrame, threshold: float = TILE_THRESHOLD) -> DataFrame:
    """Tiles with a score strictly above the threshold."""
    return scores.filter(F.col("prob") > threshold)


def gate_totals(scores: DataFrame, threshold: float = TILE_THRESHOLD) -> DataFrame:
    """One row: tiles, kept tiles, images with a kept tile, reduction, and tiles and kept tiles per image."""
    per_image = scores.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("prob") > threshold).alias("kept")
    )
    total = per_image.agg(
        F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("tiles"), F.lit(0)).alias("tiles"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_tiles"), F.count_if(F.col("kept") > 0).alias("images_with_kept"),
    )
    tiles, kept, n = F.col("tiles"), F.col("kept_tiles"), F.col("images")
    return total.select(
        "images", "tiles", "kept_tiles", "images_with_kept",
        F.when(tiles > 0, 1 - kept / tiles).otherwise(0.0).alias("tile_reduction"),
        ratio(kept, tiles).alias("keep_rate"),
        ratio(tiles, n, None).alias("tiles_per_image"), ratio(kept, n, None).alias("kept_per_image"),
    )


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """Per threshold: tiles, kept, reduction, positives, recovered, recall. One pass for all thresholds."""
    prob, positive = F.col("prob"), F.col("label") == 1
    sums = scores.agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(positive).alias("positives"),
        *[F.count_if(prob > t).alias(f"kept_{i}") for i, t in enumerate(thresholds)],
        *[F.count_if((prob > t) & positive).alias(f"found_{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"kept_{i}").alias("kept_tiles"), F.col(f"found_{i}").alias("recovered"))
        for i, t in enumerate(thresholds)
    ])
    return sums.select("tiles", "positives", F.inline(rows)).select(
        "threshold", "tiles", "kept_tiles", "positives", "recovered",
        F.when(F.col("tiles") > 0, 1 - F.col("kept_tiles") / F.col("tiles")).otherwise(0.0).alias("tile_reduction"),
        ratio(F.col("recovered"), F.col("positives")).alias("positive_recall"),
    )


def top_tiles(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best tiles of every image, by tile on ties, with ``rank``."""
    return top_rows(scores, ["image_id"], [F.col("prob").desc(), F.col("tile_id")], k)


def top_k_report(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row: reduction and recall of positives when every image keeps its ``k`` best tiles; null on no rows."""
    everything = scores.agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("label") == 1).alias("positives"))
    chosen = top_tiles(scores, k).agg(
        F.count(F.lit(1)).alias("kept_tiles"), F.count_if(F.col("label") == 1).alias("recovered")
    )
    one = F.lit(0).alias("one")
    return everything.select(one, "*").join(chosen.select(one, "*"), "one").select(
        "tiles", "kept_tiles", "positives", "recovered",
        (1 - ratio(F.col("kept_tiles"), F.col("tiles"), None)).alias("tile_reduction"),
        ratio(F.col("recovered"), F.col("positives"), None).alias("positive_recall"),
    )


def image_detections(tile_detections: DataFrame, scores: DataFrame | None = None, threshold: float = TILE_THRESHOLD,
                     tile: int = TILE_SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Detections of kept tiles in image coordinates, without ``width`` and ``height``.

    ``tile_detections`` are in tile coordinates with ``image_id, tile_id`` and the image's ``width, height``, from which
    a tile's origin follows; detections of tiles outside the grid are dropped. With ``scores``, detections of tiles that
    did not pass the gate are dropped first.
    """
    if scores is not None:
        passed = kept_tiles(scores, threshold).select("image_id", "tile_id")
        tile_detections = tile_detections.join(passed, ["image_id", "tile_id"], "left_semi")
    origin = grids.covering_origin(F.col("tile_id"), F.col("width"), F.col("height"), tile, overlap)
    moved = tile_detections.select("*", *origin).filter("tx IS NOT NULL")
    rest = [c for c in tile_detections.columns if c not in (*CORNERS, "width", "height")]
    return moved.select(*rest, *shift(corners(), F.col("tx"), F.col("ty")))


def tile_labels(tiles: DataFrame, label_lines: DataFrame) -> DataFrame:
    """Tiles with ``label`` = 1 if the label text has any line, well-formed or not."""
    found = label_lines.select("image_id", "tile_id").distinct().withColumn("has_line", F.lit(1))
    return tiles.join(found, ["image_id", "tile_id"], "left").withColumn("label", F.coalesce("has_line", F.lit(0))).drop("has_line")


def positive_tiles(labelled: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` tiles with an object."""
    return labelled.filter("label = 1").orderBy("image_id", "tile_id").limit(n)


def positive_ratio(labelled: DataFrame) -> DataFrame:
    """One row: number of tiles and share of tiles with an object."""
    return labelled.agg(F.count(F.lit(1)).alias("tiles"), F.avg("label").alias("positive_ratio"))


def without_test_images(train_tiles: DataFrame, test_tiles: DataFrame) -> DataFrame:
    """Training tiles of images that have no test tile."""
    return train_tiles.join(test_tiles.select("image_id").distinct(), "image_id", "left_anti")
