"""Detections to scores: merge per image, match, rank, summarise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.operators.average_precision import (
    ScoreOrder,
    average_precision,
    class_ids,
    mean_average_precision,
    precision_recall,
    truth_counts,
)
from boxmill.operators.matching import IOU_THRESHOLDS, match_predictions
from boxmill.operators.nms import nms
from boxmill.session import small_table, write_table


def score_predictions(
    predictions: DataFrame, truth: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS
) -> tuple[ScoreOrder, DataFrame]:
    """Matched predictions in score order, and the truth count per class."""
    counts, listed = small_table(truth_counts(truth), "truth-counts")
    # A checked length: in one task, joins and sums over the classes move nothing.
    counts = counts if listed is None else F.broadcast(counts.coalesce(1))
    return ScoreOrder(match_predictions(predictions, truth, thresholds), thresholds), counts


def evaluate(
    detections: DataFrame,
    truth: DataFrame,
    nms_iou: float = 0.5,
    max_det: int | None = 300,
    agnostic: bool = False,
    thresholds: Sequence[float] = IOU_THRESHOLDS,
) -> DataFrame:
    """One row: ``precision, recall, map50, map50_95, classes_evaluated`` of raw detections against ground truth."""
    # Read twice by the matching, so stored once.
    merged = write_table(nms(detections, nms_iou, max_det, agnostic), "merged")
    order, counts = score_predictions(merged, truth, thresholds)
    scores = precision_recall(order, counts).select("precision", "recall")
    means = mean_average_precision(average_precision(order, counts), thresholds[0])
    ids = class_ids(order.totals, counts).agg(F.count(F.lit(1)).alias("classes_evaluated"))
    # Three tables of one row each.
    key = F.lit(0).alias("one")
    parts = [t.select(key, "*") for t in (scores, means, ids)]
    return parts[0].join(parts[1], "one").join(parts[2], "one").drop("one")
