"""Detector output, run logs and the dataset manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxmill.functions.classes import CLASS_NAMES, vocabulary
from boxmill.functions.names import plain_path

CONF_FLOOR = 0.25


def detections_above(detections: DataFrame, floor: float = CONF_FLOOR) -> DataFrame:
    """Detections with at least the confidence floor; the filter reaches the Parquet scan."""
    return detections.filter(F.col("conf") >= floor)


def read_detections(spark: SparkSession, path: str, floor: float = CONF_FLOOR) -> DataFrame:
    """Detector output per tile: ``image_id, tile_id, det_id, cls, x1, y1, x2, y2, conf``."""
    return detections_above(spark.read.parquet(path), floor)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """``run, line_no, line`` of a folder of logs, one file per run, read line by line.

    Lines end at a line feed, a carriage return, or both. ``line_no`` counts from 0 in the order of the file: by the
    place of the piece a task reads, then by the line inside it.
    """
    run = F.regexp_replace(plain_path(F.col("_metadata.file_name")), r"\.[^.]*$", "")
    lines = spark.read.text(path).select(
        run.alias("run"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")
    )
    place = F.row_number().over(Window.partitionBy("run").orderBy("piece", "place")) - 1
    return lines.select("run", place.alias("line_no"), "line")


def write_manifest(images: DataFrame, path: str, names: Sequence[str] = CLASS_NAMES) -> None:
    """Dataset manifest as two JSON tables: ``splits`` (folder and image count) and ``classes`` (id and name)."""
    manifest_splits(images).write.mode("overwrite").json(f"{path}/splits")
    vocabulary(images.sparkSession, names).write.mode("overwrite").json(f"{path}/classes")


def manifest_splits(images: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """``split, path, n_images, n_classes``."""
    return images.groupBy("split").agg(F.count(F.lit(1)).alias("n_images")).select(
        "split", F.concat(F.lit("images/"), F.col("split")).alias("path"), "n_images", F.lit(len(names)).alias("n_classes")
    )
