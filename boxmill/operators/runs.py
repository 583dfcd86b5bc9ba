"""Comparison of evaluation runs from their printed logs.

Log lines: ``run, line_no, line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric name -> pattern of its line (first match decides).
METRIC_PATTERNS = {
    "images_processed": r"^Images processed:\s*(\d+)",
    "tiles_generated": r"^Tiles generated:\s*(\d+)",
    "tiles_kept": r"^Tiles kept(?: by proposal model)?:\s*(\d+)",
    "images_with_kept_tiles": r"^Images with at least one kept tile:\s*(\d+)",
    "tile_reduction": r"^Tile reduction:\s*([0-9.]+)",
    "total_time": r"^Total time:\s*([0-9.]+)\s*sec",
    "tile_fps": r"^Tile-level FPS:\s*([0-9.]+)",
    "real_fps": r"^REAL image-level FPS \(with tiling\):\s*([0-9.]+)",
    "precision": r"^Precision:\s*([0-9.]+)",
    "recall": r"^Recall:\s*([0-9.]+)",
    "map50": r"^mAP50:\s*([0-9.]+)",
    "map50_95": r"^mAP50-95:\s*([0-9.]+)",
}
WHOLE_NUMBERS = ("images_processed", "tiles_generated", "tiles_kept")
METRICS = tuple(METRIC_PATTERNS)

# Parts of a run's time, in print order.
STAGES = ("io", "tiling", "proposal", "detector", "nms", "truth")


def metric_lines(log: DataFrame) -> DataFrame:
    """``run, line_no, metric, value`` of the lines that report a metric; one that is no number does not."""
    line = F.btrim(F.col("line"), F.lit(" \t\r\n\f\v"))
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for metric, pattern in reversed(METRIC_PATTERNS.items()):
        hit = line.rlike(pattern)
        name = F.when(hit, metric).otherwise(name)
        text = F.when(hit, F.regexp_extract(line, pattern, 1)).otherwise(text)
    found = log.select("run", "line_no", name.alias("metric"), text.alias("text")).filter("metric is not null")
    return found.select("run", "line_no", "metric", F.col("text").try_cast("double").alias("value")).filter("value IS NOT NULL")


def run_metrics(log: DataFrame) -> DataFrame:
    """``run, metric, value``: the last line of each metric wins."""
    return metric_lines(log).groupBy("run", "metric").agg(F.max_by("value", "line_no").alias("value"))


def _per(part: str, whole: str) -> Column:
    return F.when(F.col(whole) != 0, F.col(part) / F.col(whole))


def run_table(log: DataFrame) -> DataFrame:
    """One row per run: the metrics as columns (null if not printed) and the ratios per image."""
    lines = metric_lines(log)
    last = [
        F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("line_no"))).alias(m)
        for m in METRICS
    ]
    wide = lines.groupBy("run").agg(*last)
    typed = [F.col(m).try_cast("long").alias(m) if m in WHOLE_NUMBERS else F.col(m) for m in METRICS]
    return log.select("run").distinct().join(wide, "run", "left").select("run", *typed).select(
        "*",
        _per("tiles_generated", "images_processed").alias("tiles_per_image"),
        _per("tiles_kept", "images_processed").alias("kept_per_image"),
        F.when(
            (F.col("images_processed") != 0) & F.col("tiles_kept").isNotNull(),
            F.coalesce(_per("tiles_kept", "tiles_generated"), F.lit(0.0)),
        ).alias("keep_rate"),
    )


def kept_delta(runs: DataFrame, first: str, second: str) -> DataFrame:
    """One row: kept tiles per image of two runs and the difference; a missing count is 0, no images gives null."""
    kept = F.coalesce("tiles_kept", F.lit(0)) / F.when(F.col("images_processed") != 0, F.col("images_processed"))
    picked = runs.filter(F.col("run").isin(first, second)).agg(
        F.max(F.when(F.col("run") == first, kept)).alias("first_kept"),
        F.max(F.when(F.col("run") == second, kept)).alias("second_kept"),
    )
    return picked.select(
        F.lit(first).alias("first_run"), F.lit(second).alias("second_run"), "first_kept", "second_kept",
        (F.col("first_kept") - F.col("second_kept")).alias("kept_difference"),
    )


def throughput(runs: DataFrame) -> DataFrame:
    """Frames per second from recorded times: ``run, images, kept_tiles, total_time, io_time, truth_time``."""
    positive = F.col("total_time") > 0
    busy = F.col("total_time") - F.col("truth_time") - F.col("io_time")
    return runs.select(
        "run",
        F.when(positive, F.col("kept_tiles") / F.col("total_time")).otherwise(0.0).alias("tile_fps"),
        F.when(positive, F.try_divide(F.col("images"), busy)).otherwise(0.0).alias("image_fps"),
    )


def stage_shares(times: DataFrame, total: DataFrame) -> DataFrame:
    """``run, stage, seconds, share``: recorded stage times, and ``other`` for what is left of the total.

    ``times``: ``run, stage, seconds``; ``total``: ``run, total_time``.
    """
    per_run = times.groupBy("run").agg(F.sum("seconds").alias("known"))
    other = total.join(per_run, "run", "left").select(
        "run", F.lit("other").alias("stage"), (F.col("total_time") - F.coalesce("known", F.lit(0.0))).alias("seconds")
    )
    summed = times.groupBy("run", "stage").agg(F.sum("seconds").alias("seconds"))
    return summed.unionByName(other).join(total, "run").select(
        "run", "stage", "seconds", F.try_divide("seconds", "total_time").alias("share")
    )
