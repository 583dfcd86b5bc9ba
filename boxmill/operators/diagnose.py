"""Per-image quality and error reports on integer boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.functions.geometry import CORNERS, int_iou
from boxmill.functions.scores import score_order
from boxmill.operators.matching import overlap_pairs
from boxmill.operators.nms import nms
from boxmill.session import write_table

MATCH_IOU = 0.5


def int_boxes(df: DataFrame) -> DataFrame:
    """Corners truncated to integers; null where a corner is no such number, which meets nothing."""
    return df.withColumns({c: F.col(c).try_cast("int") for c in CORNERS})


def first_matches(predictions: DataFrame, truth: DataFrame, min_iou: float = MATCH_IOU) -> DataFrame:
    """For each matched truth box the first overlapping prediction of any class, in score order.

    Columns: ``image_id, box_id, truth_cls``, ``tile_id`` if predictions have it, ``det_id, pred_cls``. A prediction may serve
    several boxes. NaN and then null scores come last.
    """
    pairs = overlap_pairs(int_boxes(predictions), int_boxes(truth), min_iou, same_class=False, iou_of=int_iou)
    ids = detection_ids(predictions)
    order = [c.alias(f"key_{n}") for n, c in enumerate(score_order(F.col("conf")))]
    first = F.min(F.struct(*order, *ids, "cls")).alias("first")
    return pairs.groupBy("image_id", "box_id", "truth_cls").agg(first).select(
        "image_id", "box_id", "truth_cls", *(F.col(f"first.{c}").alias(c) for c in ids), F.col("first.cls").alias("pred_cls")
    )


def detection_ids(predictions: DataFrame) -> list[str]:
    """What names a prediction within its image: its number, and its tile if there is one."""
    return [c for c in ("tile_id", "det_id") if c in predictions.columns]


def image_quality(images: DataFrame, predictions: DataFrame, truth: DataFrame, min_iou: float = MATCH_IOU) -> DataFrame:
    """Per image: matches, errors, recall, precision, F1, mean confidence and quality (F1 x confidence).

    Recall is 1 without truth boxes, precision 0 without predictions.
    """
    # Uses per prediction first: a distinct count that cannot gather one image in one buffer.
    used = (
        first_matches(predictions, truth, min_iou)
        .groupBy("image_id", *detection_ids(predictions))
        .agg(
            F.count_if(F.col("pred_cls") == F.col("truth_cls")).alias("right"),
            F.count_if(F.col("pred_cls") != F.col("truth_cls")).alias("wrong"),
        )
        .groupBy("image_id")
        .agg(
            F.sum("right").alias("correct_matches"), F.sum("wrong").alias("class_errors"),
            F.count(F.lit(1)).alias("n_used"),
        )
    )
    preds = predictions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pred"), F.avg("conf").alias("avg_conf"))
    boxes = truth.groupBy("image_id").agg(F.count(F.lit(1)).alias("total_gt"))
    joined = (
        images.select("image_id")
        .join(boxes, "image_id", "left")
        .join(preds, "image_id", "left")
        .join(used, "image_id", "left")
        .na.fill(0, ["total_gt", "n_pred", "avg_conf", "correct_matches", "class_errors", "n_used"])
    )
    p, r = F.col("precision"), F.col("recall")
    return (
        joined.withColumn("recall", F.when(F.col("total_gt") > 0, F.col("correct_matches") / F.col("total_gt")).otherwise(1.0))
        .withColumn("precision", F.when(F.col("n_pred") > 0, F.col("correct_matches") / F.col("n_pred")).otherwise(0.0))
        .withColumn("f1_score", F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0))
        .select(
            "image_id", "total_gt", "n_pred", "correct_matches", "class_errors",
            (F.col("n_pred") - F.col("n_used")).alias("false_positives"),
            (F.col("total_gt") - F.col("n_used")).alias("missed_gt"),
            "recall", "precision", "f1_score", "avg_conf", (F.col("f1_score") * F.col("avg_conf")).alias("quality"),
        )
    )


def report_boxes(detections: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """Class-agnostic NMS on integer boxes without a limit, as the error report uses it."""
    return nms(int_boxes(detections), iou_threshold, max_det=None, agnostic=True)


def image_errors(images: DataFrame, predictions: DataFrame, truth: DataFrame, min_iou: float = MATCH_IOU) -> DataFrame:
    """Per image: unmatched truth boxes, overlaps of another class, predictions without a box, and ``wrong``."""
    pairs = overlap_pairs(int_boxes(predictions), int_boxes(truth), min_iou, same_class=False, iou_of=int_iou)
    # One pass over the pairs: each adds to its box and to its prediction, summed up before anything moves.
    mixed = F.when(F.col("cls") != F.col("truth_cls"), 1).otherwise(0)
    # The pairs are stored first: they are much narrower than the rows that met, whose shuffle then goes before the next one.
    pairs = write_table(pairs.select("image_id", "box_id", *detection_ids(predictions), mixed.alias("mixed")), "error-pairs")
    ids = F.struct(*detection_ids(predictions))
    no_id = F.lit(None).cast(pairs.select(ids.alias("i")).schema["i"].dataType)
    sides = F.array(
        F.struct(F.col("box_id").alias("box"), no_id.alias("det"), "mixed"),
        F.struct(F.lit(None).cast(pairs.schema["box_id"].dataType).alias("box"), ids.alias("det"), F.lit(0).alias("mixed")),
    )
    used = (
        pairs.select("image_id", F.inline(sides))
        .groupBy("image_id", "box", "det")
        .agg(F.sum("mixed").alias("mixed"))
        .groupBy("image_id")
        .agg(
            F.count_if(F.col("det").isNull()).alias("matched_gt"),
            F.sum("mixed").alias("class_conflicts"),
            F.count_if(F.col("det").isNotNull()).alias("n_used"),
        )
    )
    preds = predictions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pred"))
    boxes = truth.groupBy("image_id").agg(F.count(F.lit(1)).alias("total_gt"))
    joined = images.select("image_id")
    for part in (boxes, preds, used):
        joined = joined.join(part, "image_id", "left")
    joined = joined.na.fill(0, ["total_gt", "n_pred", "matched_gt", "class_conflicts", "n_used"])
    missed, extra = F.col("total_gt") - F.col("matched_gt"), F.col("n_pred") - F.col("n_used")
    return joined.select(
        "image_id", missed.alias("missed_gt"), "class_conflicts", extra.alias("unused_preds"),
        ((missed > 0) | (F.col("class_conflicts") > 0) | (extra > 0)).alias("wrong"),
    )


def best_images(quality: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` images of highest quality, by image on ties."""
    return quality.orderBy(F.col("quality").desc(), "image_id").limit(n)


def wrong_images(errors: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` wrong images in listing order."""
    return errors.filter("wrong").orderBy("image_id").limit(n)
