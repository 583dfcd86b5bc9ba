"""Predictions against ground truth: candidate pairs, best box, true positives."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmill.functions.cells import CELL, meet_once, placeable, searching, waiting
from boxmill.functions.geometry import CORNERS, corners, iou, overlaps
from boxmill.functions.once import computed_once
from boxmill.functions.scores import score_order
from boxmill.operators.ranking import group_sizes, join_keys
from boxmill.session import small_table

IOU_THRESHOLDS = tuple((50 + 5 * k) / 100 for k in range(10))


def _keys(predictions: DataFrame) -> list[str]:
    """What names a prediction: image, tile if there is one, and the detection's number there."""
    return [c for c in ("image_id", "tile_id", "det_id") if c in predictions.columns]


# Rows of one image, on either side, that meet by the image alone. In larger images they meet in grid cells, with the same result.
MEETING_ROWS = 256

Iou = Callable[[Sequence[Column], Sequence[Column]], Column]


def _split_crowds(predictions: DataFrame, truth: DataFrame, limit: int) -> list[tuple[DataFrame, DataFrame, bool]]:
    """Both sides, with whether an image is crowded: all ordinary images, and then the crowded ones, so far as there are any."""
    key = ["image_id"]
    found = [group_sizes(t, key, limit) for t in (predictions, truth)]
    listed = [large.select(*key) for large, _ in found if large is not None]
    if not listed:
        return [(predictions, truth, False)]
    if not any(others for _, others in found):
        return [(predictions, truth, True)]
    crowds, _ = small_table(reduce(DataFrame.union, listed).distinct(), "crowds")
    ways = (("left_anti", False), ("left_semi", True))
    return [(*(join_keys(t, crowds, key, how) for t in (predictions, truth)), crowded) for how, crowded in ways]


def _sides(predictions: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    return predictions.select(*_keys(predictions), "cls", "conf", *CORNERS), truth.select("image_id", "box_id", F.col("cls").alias("truth_cls"), *CORNERS)


def _boxes() -> list[list[Column]]:
    return [[F.col(f"{side}.{c}") for c in CORNERS] for side in ("p", "t")]


def _meeting(predictions: DataFrame, truth: DataFrame, same_class: bool, how: str) -> DataFrame:
    """``p`` and ``t`` joined where two boxes of an image overlap.

    A box that meets nothing has no first corner here, so that few terms are left per pair. The class is no key of the join: rows stay where
    their image lies, and what follows moves nothing again.
    """
    first = F.when(placeable(corners()), F.col(CORNERS[0]))
    # Corners enter every comparison, and may be computed ones.
    p, t = (computed_once(side, *CORNERS).withColumn(CORNERS[0], first).alias(name) for side, name in ((predictions, "p"), (truth, "t")))
    near = overlaps(*_boxes())
    if same_class:
        near = F.when(F.col("p.cls") == F.col("t.truth_cls"), near)
    return p.join(t, (F.col("p.image_id") == F.col("t.image_id")) & near, how)


def _reaches(min_iou: float, iou_of: Iou) -> Column:
    """The IoU of ``p`` and ``t`` if it is at least ``min_iou``, else null. Of boxes that are far from it no whole areas are computed."""
    value = iou_of(*_boxes())
    if iou_of is not iou:
        rough = iou(*([c.cast("double") for c in box] for box in _boxes()))
        value = F.when(rough >= min_iou * (1 - 1e-9), value)
    return F.when(value >= min_iou, value)


def overlap_pairs(
    predictions: DataFrame,
    truth: DataFrame,
    min_iou: float,
    same_class: bool = True,
    iou_of: Iou = iou,
    meeting_rows: int = MEETING_ROWS,
) -> DataFrame:
    """Pairs of one image with an IoU of at least ``min_iou`` (> 0), each pair once.

    Columns: ``image_id``, ``tile_id`` if predictions have it, ``det_id, cls, conf, box_id, truth_cls, iou``. Images with at most
    ``meeting_rows`` rows on either side take a join on the image. In larger ones the join key holds a grid cell of a size level, so a
    crowded image spreads over many keys, far-apart boxes never meet, and a box of any size lies in a few cells. Both give the same rows.
    Boxes that are not finite or have no area meet nothing.
    """
    parts = []
    for some, boxes, crowded in _split_crowds(predictions, truth, meeting_rows):
        if crowded:
            parts.append(_pairs_in_cells(some, boxes, min_iou, same_class, iou_of))
            continue
        met = _meeting(*_sides(some, boxes), same_class, "inner")
        pairs = met.select(*(F.col(f"p.{c}") for c in _keys(predictions)), "p.cls", "p.conf", "box_id", "truth_cls", _reaches(min_iou, iou_of).alias("iou"))
        parts.append(pairs.filter("iou IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def _pairs_in_cells(predictions: DataFrame, truth: DataFrame, min_iou: float, same_class: bool, iou_of: Iou) -> DataFrame:
    """``overlap_pairs`` for images of any size."""
    probes, homes = _sides(predictions, truth)
    # Corners enter levels, cells and filters many times, and may be computed ones.
    probes, homes = searching(computed_once(probes, *CORNERS), corners(), min_iou), waiting(computed_once(homes, *CORNERS), corners(), min_iou)
    p, t = probes.alias("p"), homes.alias("t")
    on = [F.col(f"p.{c}") == F.col(f"t.{c}") for c in ("image_id", *CELL)]
    on.append(meet_once(F.col("p.search_level"), F.col("t.wait_level"), F.col(f"t.{CELL[0]}")))
    if same_class:
        on.append(F.col("p.cls") == F.col("t.truth_cls"))
    value = iou_of(*_boxes())
    return (
        p.join(t, reduce(Column.__and__, on))
        .select(*(F.col(f"p.{c}") for c in _keys(predictions)), "p.cls", "p.conf", "box_id", "truth_cls", value.alias("iou"))
        .filter(F.col("iou") >= min_iou)
    )


def best_truth(predictions: DataFrame, truth: DataFrame, min_iou: float, meeting_rows: int = MEETING_ROWS) -> DataFrame:
    """Each prediction with the same-class truth box of highest IoU, the lowest ``box_id`` on ties.

    Columns: the prediction's key, ``cls, conf, best_iou, best_box``; the last two are null when no box reaches
    ``min_iou``. Ordinary images (see ``overlap_pairs``) are joined and summed up where their rows lie, by one shuffle on the
    image. In crowded ones unmatched predictions enter the same aggregation as rows without a pair, which saves a
    join back, and partial aggregation shrinks the pairs before they move. The key (image, tile if any, number) names
    one prediction; two rows with the same key, class and score fail the job.
    """
    keys = [*_keys(predictions), "cls", "conf"]
    parts = []
    for some, boxes, crowded in _split_crowds(predictions, truth, meeting_rows):
        if crowded:
            pair = F.struct("iou", (-F.col("box_id")).alias("neg_box"))
            pairs = _pairs_in_cells(some, boxes, min_iou, True, iou).select(*keys, pair.alias("best"), F.lit(0).alias("own"))
            alone = some.select(*keys, F.lit(None).cast(pairs.schema["best"].dataType).alias("best"), F.lit(1).alias("own"))
            rows, twice = pairs.unionByName(alone), F.sum("own") > 1
        else:
            probes, homes = _sides(some, boxes)
            met = _meeting(probes.withColumn("own", F.monotonically_increasing_id()), homes, True, "left")
            met = met.select(*(F.col(f"p.{c}") for c in keys), _reaches(min_iou, iou).alias("iou"), "box_id", "own")
            best = F.when(F.col("iou").isNotNull(), F.struct("iou", (-F.col("box_id")).alias("neg_box")))
            rows, twice = met.select(*keys, best.alias("best"), "own"), F.min("own") < F.max("own")
        fault = F.when(twice, F.raise_error(F.lit("two detections share image, tile, number, class and score")).cast("int"))
        parts.append(
            rows.groupBy(*keys)
            .agg(F.max("best").alias("best"), fault.alias("fault"))
            .filter("fault IS NULL")
            .select(*keys, F.col("best.iou").alias("best_iou"), (-F.col("best.neg_box")).alias("best_box"))
        )
    return reduce(DataFrame.unionByName, parts)


def match_predictions(
    predictions: DataFrame, truth: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS
) -> DataFrame:
    """``best_truth`` plus ``hits``: bit k is set if the prediction is a true positive at ``thresholds[k]``.

    A prediction tries only its best box. It is a true positive at t if its IoU reaches t and no better ranked
    prediction with the same best box reaches t. So the highest IoU among those before it settles all thresholds at
    once: it is a hit exactly for the thresholds above that value and up to its own IoU.
    """
    best = best_truth(predictions, truth, min(thresholds))
    # Unmatched predictions are spread over window groups of their own instead of sharing the null box.
    ids = _keys(predictions)[1:]
    alone = F.when(F.col("best_box").isNull(), F.struct(*ids))
    claims = (
        Window.partitionBy("image_id", "cls", "best_box", alone)
        .orderBy(*score_order(F.col("conf")), *ids)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    taken = F.coalesce(F.max("best_iou").over(claims), F.lit(-1.0))
    matched = best.withColumn("taken", taken)
    bits = [
        F.when((F.col("best_iou") >= t) & (F.col("taken") < t), F.lit(1 << k)).otherwise(0)
        for k, t in enumerate(thresholds)
    ]
    return matched.withColumn("hits", sum(bits[1:], bits[0])).drop("taken")
