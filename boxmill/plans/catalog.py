"""Every operator as a named query over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmill.functions import classes, grids, names
from boxmill.functions.geometry import CORNERS, clamp01, corners, corners_to_center, int_iou
from boxmill.functions.pixels import FEATURES
from boxmill.operators import diagnose, gating, runs, splitting, tiling
from boxmill.operators.average_precision import (
    EPS,
    average_precision,
    class_ids,
    mean_average_precision,
    precision_recall,
)
from boxmill.operators.features import (
    class_weights,
    extract_features,
    fit_gate,
    gate_coefficients,
    linear_scores,
    load_linear,
    loss_gradient,
    save_linear,
    standardised,
)
from boxmill.operators.matching import best_truth, match_predictions, overlap_pairs
from boxmill.operators.nms import nms
from boxmill.plans import standins
from boxmill.plans.evaluation import evaluate, score_predictions
from boxmill.plans.gate import fit_and_score
from boxmill.session import shared_dir, write_table
from boxmill.sources import annotations, images, labels, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPORT_IOU = 0.45


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    return df.select(*[
        F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
        for c in df.schema
    ])


# --- sources ---------------------------------------------------------------------------------------------------


def _paths(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("image_id")
    ext = F.get(F.array(*[F.lit(e) for e in ("jpg", "jpeg", "png", "JPG", "bmp")]), (key % 5).cast("int"))
    return standins.images(spark, d).select(
        F.concat(F.lit("/data/"), F.col("split"), F.lit("/images/img.v1_"), key.cast("string"), F.lit("."), ext).alias("path")
    )


@query
def image_listing(spark, d):
    return images.list_images(_paths(spark, d))


@query
def image_listing_any_case(spark, d):
    return images.list_images(_paths(spark, d), ignore_case=True)


@query
def image_sizes(spark, d):
    broken = F.col("image_id") % 50 == 0
    decoded = standins.images(spark, d).select(
        F.col("image_id").cast("string").alias("path"),
        *[F.when(broken, -1).otherwise(F.col(c)).alias(c) for c in ("width", "height")],
    )
    return images.image_sizes(decoded)


def _label_lines(spark: SparkSession, d: str, clean: bool) -> DataFrame:
    """Label text per box, values as four decimals; without ``clean`` some lines are malformed or blank."""
    def number(c: str):
        return F.concat(F.lit("0."), F.lpad(F.col(c).cast("int").cast("string"), 4, "0"))

    good = F.concat_ws(" ", F.concat(F.col("cls").cast("string"), F.lit(".0")), *[number(c) for c in CORNERS])
    line = good
    if not clean:
        line = F.when(F.col("box_id") % 7 == 0, F.concat(good, F.lit(" 1"))).when(F.col("box_id") % 5 == 0, " ").otherwise(
            F.concat(F.lit("  "), good, F.lit("\t"))
        )
    return standins.truth(spark, d).select("image_id", "width", "height", "box_id", line.alias("line"))


@query
def labels_tolerant(spark, d):
    return labels.parse_label_lines(_label_lines(spark, d, clean=False)).drop("width", "height")


@query
def labels_strict(spark, d):
    return labels.parse_label_lines(_label_lines(spark, d, clean=True), strict=True).drop("width", "height")


@query
def detections_above_floor(spark, d):
    return tables.detections_above(standins.detections(spark, d), 0.5)


@query
def run_log_metrics(spark, d):
    return rounded(runs.run_metrics(standins.run_logs(spark, d)))


@query
def dataset_manifest(spark, d):
    return tables.manifest_splits(standins.images(spark, d))


@query
def tile_crops(spark, d):
    tiles = standins.pixel_tiles(spark, d)
    key = F.concat_ws("_", "image_id", "tile_id").alias("path")
    source = tiles.select(key, "height", "width", F.lit(3).alias("nChannels"), "data")
    return images.crop_tiles(source, tile=5, overlap=0.2).select("path", "tile_id", "x", "y", F.hex("data").alias("pixels"))


@query
def tile_crops_padded(spark, d):
    tiles = standins.pixel_tiles(spark, d)
    key = F.concat_ws("_", "image_id", "tile_id").alias("path")
    source = tiles.select(key, "height", "width", F.lit(3).alias("nChannels"), "data")
    return images.crop_tiles(source, tile=10).select("path", "tile_id", "x", "y", F.hex("data").alias("pixels"))


# --- annotations -------------------------------------------------------------------------------------------------


@query
def annotations_converted(spark, d):
    return rounded(annotations.convert_annotations(*standins.annotation_documents(spark, d)), 9)


@query
def annotations_converted_short(spark, d):
    return rounded(annotations.convert_annotations(*standins.annotation_documents(spark, d), full=False), 9)


@query
def annotation_counts(spark, d):
    pictures, documents = standins.annotation_documents(spark, d)
    # A fifth of the images has no document, a seventh of the documents is broken, some are odd, some images unreadable.
    digits = F.regexp_extract("file", r"_(\d+)$", 1).cast("int")
    odd = F.when(digits % 2 == 0, F.lit('{"a": 1, "a": 2}')).otherwise(F.lit('{"a": NaN}'))
    broken = F.when(digits % 7 == 0, F.lit('{"objects": [')).when(digits % 11 < 2, odd).otherwise(F.col("text"))
    kept = documents.withColumn("text", broken).filter(digits % 5 != 0)
    parsed = write_table(annotations.parse_documents(kept), "documents")
    sized = pictures.withColumn("width", F.when(digits % 3 != 0, F.col("width")))
    return annotations.conversion_counts(sized, parsed, annotations.convert_annotations(sized, parsed))


@query
def label_text(spark, d):
    """Label files of all images as text, negatives included, written, read back, parsed, and put back into whole pixels."""
    truth = standins.truth(spark, d)
    stem = F.lpad(F.col("image_id").cast("string"), 12, "0").alias("stem")
    center = corners_to_center(corners(), F.col("width"), F.col("height"))
    boxes = truth.select("split", stem, "box_id", "cls", *center)
    pictures = standins.images(spark, d).select("split", stem, "width", "height")
    texts = write_table(labels.label_texts(boxes, pictures), "label-texts")
    found = labels.parse_label_lines(labels.split_lines(texts), strict=True)
    whole = [F.round(F.col(c) * F.col(side) * 2).cast("long").alias(c) for c, side in zip(labels.FIELDS, ("width", "height") * 2)]
    return pictures.join(found, ["split", "stem"], "left").select("split", "stem", "box_id", "cls", *whole)


@query
def label_files(spark, d):
    """One label file per image, negatives included, written and read back as files by tasks."""
    truth = standins.truth(spark, d)
    stem = F.lpad(F.col("image_id").cast("string"), 12, "0").alias("stem")
    center = corners_to_center(corners(), F.col("width"), F.col("height"))
    # Every seventh image is a negative.
    boxes = truth.where("image_id % 7 <> 0").select("split", stem, "box_id", "cls", *center)
    pictures = standins.images(spark, d).select("split", stem, "width", "height")
    path = f"{shared_dir(spark)}/boxmill/label-files-{uuid.uuid4().hex}"
    labels.write_label_files(boxes, pictures.select("split", "stem"), path)
    found = labels.read_label_files(spark, path, strict=True)
    whole = [F.round(F.col(c) * F.col(side) * 2).cast("long").alias(c) for c, side in zip(labels.FIELDS, ("width", "height") * 2)]
    return pictures.join(found, ["split", "stem"], "left").select("split", "stem", "box_id", "cls", *whole)


@query
def class_distribution(spark, d):
    boxes = annotations.convert_annotations(*standins.annotation_documents(spark, d))
    return rounded(classes.class_distribution(boxes))


# --- projections ---------------------------------------------------------------------------------------------------


@query
def boxes_normalised(spark, d):
    center = corners_to_center(corners(), F.col("width"), F.col("height"))
    return rounded(standins.truth(spark, d).select("image_id", "box_id", "cls", *center), 9)


@query
def boxes_clamped(spark, d):
    # Boxes are pushed over the edge, so every clamp is used.
    pushed = [(F.col(c) * 2 - 200) for c in CORNERS]
    center = corners_to_center(pushed, F.col("width"), F.col("height"))
    clamped = [clamp01(c).alias(n) for c, n in zip(center, labels.FIELDS)]
    return rounded(standins.truth(spark, d).select("image_id", "box_id", *clamped), 9)


@query
def boxes_in_pixels(spark, d):
    boxes = labels.parse_label_lines(_label_lines(spark, d, clean=False)).drop("width", "height")
    return rounded(labels.pixel_boxes(boxes, standins.images(spark, d), ["image_id"]).drop("split"))


@query
def boxes_in_int_pixels(spark, d):
    boxes = labels.parse_label_lines(_label_lines(spark, d, clean=True), strict=True).drop("width", "height")
    return labels.pixel_boxes(boxes, standins.images(spark, d), ["image_id"], integer=True).drop("split")


@query
def class_names(spark, d):
    cls = (F.col("l_partkey") % 85).cast("int").alias("cls")
    found = standins.table(spark, d, "lineitem").select(cls).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return found.select("cls", classes.class_name(F.col("cls")).alias("name"), classes.reduced_name(F.col("cls")).alias("reduced_name"), "n")


@query
def tile_starts(spark, d):
    starts = standins.images(spark, d).select("image_id", grids.tile_starts(F.col("width"), 740, 0.2).alias("starts"))
    return starts.select("image_id", F.posexplode("starts").alias("col", "x1"))


@query
def fixed_tiles(spark, d):
    return standins.tiles(spark, d).drop("split", "width", "height")


@query
def adaptive_plan(spark, d):
    return rounded(
        _plan(spark, d).select("image_id", _share_in_pixels(), "n_tiles", "overlap_px", "tile_w", "tile_h", "step_x", "step_y")
    )


def _share_in_pixels():
    """The share as an area: a number with one decimal, so that rounding has no ties."""
    return (F.col("share") * F.col("width") * F.col("height")).alias("share_pixels")


@query
def adaptive_tiles(spark, d):
    return tiling.adaptive_tiles(_plan(spark, d)).select("image_id", "tile_id", "row", "col", *CORNERS, "is_partial")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return tiling.adaptive_plan(standins.images(spark, d), standins.truth(spark, d))


@query
def tile_base_names(spark, d):
    file = F.concat(names.tile_stem(F.concat(F.lit("a_tile_"), F.col("image_id").cast("string")), F.col("tile_id")), F.lit(".jpg"))
    files = standins.tiles(spark, d).select(file.alias("file"))
    return files.select(
        names.base_of_tile(names.stem(F.col("file"))).alias("base"), names.base_of_tile_file(F.col("file")).alias("file_base")
    ).distinct()


# --- tiles and boxes -----------------------------------------------------------------------------------------------


@query
def tile_box_overlaps(spark, d):
    cut = tiling.tile_box_overlaps(standins.truth(spark, d))
    return rounded(cut.select("image_id", "tile_id", "box_id", "ix1", "iy1", "ix2", "iy2", "visible"))


@query
def fixed_tile_boxes(spark, d):
    return rounded(standins.tile_boxes(spark, d), 9)


@query
def adaptive_tile_boxes(spark, d):
    return rounded(tiling.adaptive_tile_boxes(_plan(spark, d), standins.truth(spark, d)), 9)


@query
def tile_labels_with_negatives(spark, d):
    counts = standins.tile_boxes(spark, d).groupBy("image_id", "tile_id").agg(F.count(F.lit(1)).alias("n_boxes"))
    tiles = standins.tiles(spark, d).select("image_id", "tile_id")
    return tiles.join(counts, ["image_id", "tile_id"], "left").na.fill(0, ["n_boxes"])


@query
def label_sizes(spark, d):
    sizes = tiling.label_sizes(standins.truth(spark, d)).join(standins.images(spark, d), "image_id")
    return rounded(sizes.select("image_id", _share_in_pixels(), "overlap_px"))


@query
def tiles_per_axis(spark, d):
    return rounded(tiling.tiles_per_axis_stats(_plan(spark, d)))


@query
def stitched_boxes(spark, d):
    return tiling.stitch(standins.tile_boxes(spark, d, carry=("width", "height")))


@query
def stitched_totals(spark, d):
    # The stored tiles are a table of their own: the names of tile files, written out and parsed back.
    grid = standins.tiles(spark, d)
    file = names.tile_stem(F.col("image_id").cast("string"), F.col("tile_id")).alias("stem")
    files = write_table(grid.select(file), "tile-files")
    stored = files.select(
        names.base_of_tile(F.col("stem")).cast("long").alias("image_id"), F.regexp_extract("stem", r"(\d+)$", 1).cast("int").alias("tile_id")
    )
    grid = tiling.check_stored_tiles(grid, stored)
    return tiling.stitched_totals(grid, standins.tile_boxes(spark, d))


@query
def images_with_labels(spark, d):
    boxes = standins.truth(spark, d).select("image_id", "box_id", "cls")
    return standins.images(spark, d).select("image_id", "split").join(boxes, "image_id", "left")


# --- detections ------------------------------------------------------------------------------------------------------


@query
def merged_detections(spark, d):
    return nms(standins.detections(spark, d))


@query
def merged_detections_agnostic(spark, d):
    return nms(standins.detections(spark, d), agnostic=True)


@query
def report_boxes(spark, d):
    return diagnose.report_boxes(standins.detections(spark, d))


@query
def merged_detections_crowded(spark, d):
    """All detections in three images, some scores missing or NaN, numbers that repeat: NMS of crowds, in rounds."""
    score = F.when(F.col("tile_id") % 97 == 0, F.lit(None)).when(F.col("tile_id") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("conf"))
    return nms(_crowd(standins.detections(spark, d)).withColumn("conf", score), max_det=None)


@query
def image_errors_crowded(spark, d):
    """The error report of three crowded images."""
    preds = write_table(diagnose.report_boxes(_crowd(standins.detections(spark, d))), "reported")
    # Box numbers repeat over the pictures of a crowd, so the picture is part of them.
    truth = _crowd(standins.truth(spark, d)).withColumn("box_id", F.col("tile_id") * 10_000_000 + F.col("box_id"))
    truth = write_table(truth.select("image_id", "box_id", "cls", *CORNERS), "crowd-truth")
    images = standins.images(spark, d).select((F.col("image_id") % 3).alias("image_id")).distinct()
    return diagnose.image_errors(images, preds, truth)


def _crowd(boxes: DataFrame) -> DataFrame:
    """All pictures laid out in three, 2,000 pixels apart, so that boxes keep their surroundings; ``tile_id`` is the picture."""
    place = F.floor(F.col("image_id") / 3)
    moved = {c: F.col(c) + 2000.0 * (place % 10_000 if c[0] == "x" else F.floor(place / 10_000)) for c in CORNERS}
    return boxes.withColumns(moved | {"tile_id": F.col("image_id"), "image_id": F.col("image_id") % 3})


@query
def gated_detections(spark, d):
    """Detections in tile coordinates of their first tile, moved back for tiles that pass the gate."""
    tile_id = (F.col("det_id") % 2).alias("tile_id")
    sized = standins.detections(spark, d, carry=("width", "height"))
    on_tiles = sized.select("image_id", tile_id, "det_id", "cls", *CORNERS, "conf", "width", "height")
    moved = gating.image_detections(on_tiles, standins.tile_scores(spark, d))
    return moved.select("image_id", "tile_id", "det_id", "cls", *CORNERS, "conf")


def _merged(spark: SparkSession, d: str, iou_threshold: float = 0.5) -> DataFrame:
    return write_table(nms(standins.detections(spark, d), iou_threshold), "merged")


@query
def candidate_pairs(spark, d):
    return rounded(overlap_pairs(_merged(spark, d), standins.truth(spark, d), 0.5))


@query
def candidate_pairs_any_class(spark, d):
    preds, boxes = (diagnose.int_boxes(t) for t in (_merged(spark, d), standins.truth(spark, d)))
    return rounded(overlap_pairs(preds, boxes, 0.5, same_class=False, iou_of=int_iou))


@query
def best_truth_boxes(spark, d):
    return rounded(best_truth(_merged(spark, d), standins.truth(spark, d), 0.5))


@query
def true_positives(spark, d):
    return rounded(match_predictions(_merged(spark, d), standins.truth(spark, d)).drop("best_iou"))


def _scored(spark: SparkSession, d: str):
    return score_predictions(_merged(spark, d), standins.truth(spark, d))


@query
def precision_recall_curve(spark, d):
    order, counts = _scored(spark, d)
    step = 1 / (F.col("n_gt") + F.lit(EPS))
    return rounded(
        order.curve().join(counts, "cls").select(
            "cls", "iou_thr", "rank", "tp_cum", "precision", "envelope",
            (F.col("tp_cum") * step).alias("recall"), step.alias("recall_step"),
        )
    )


@query
def class_counts_by_threshold(spark, d):
    order, _ = _scored(spark, d)
    return order.class_counts()


@query
def average_precision_by_class(spark, d):
    return rounded(average_precision(*_scored(spark, d)))


@query
def micro_precision_recall(spark, d):
    return rounded(precision_recall(*_scored(spark, d)))


@query
def mean_average_precisions(spark, d):
    return rounded(mean_average_precision(average_precision(*_scored(spark, d))))


@query
def evaluated_classes(spark, d):
    # Predicted ids reach past the true ones.
    preds = standins.detections(spark, d).withColumn("cls", F.col("cls") + (F.col("det_id") % 3).cast("int"))
    return class_ids(preds, standins.truth(spark, d))


@query
def evaluation(spark, d):
    return rounded(evaluate(standins.detections(spark, d), standins.truth(spark, d)))


@query
def evaluation_unseen_classes(spark, d):
    """Some predicted classes have no ground truth: their false positives do not count."""
    preds = standins.detections(spark, d).withColumn("cls", F.when(F.col("det_id") % 5 == 0, F.col("cls") + 4).otherwise(F.col("cls")))
    return rounded(evaluate(preds, standins.truth(spark, d)))


# --- diagnosis ---------------------------------------------------------------------------------------------------


@query
def first_matches(spark, d):
    return diagnose.first_matches(_merged(spark, d, REPORT_IOU), standins.truth(spark, d))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.image_quality(standins.images(spark, d), _merged(spark, d, REPORT_IOU), standins.truth(spark, d))


@query
def image_quality(spark, d):
    return rounded(_quality(spark, d), 12)


@query
def image_quality_by_tile(spark, d):
    """Quality of detections numbered per tile, so that numbers repeat in an image, some scores missing or NaN."""
    merged = _merged(spark, d, REPORT_IOU)
    score = F.when(F.col("det_id") % 11 == 0, F.lit(None)).when(F.col("det_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("conf"))
    per_tile = merged.withColumns({"tile_id": F.floor(F.col("det_id") / 2), "det_id": F.col("det_id") % 2, "conf": score})
    report = diagnose.image_quality(standins.images(spark, d), per_tile, standins.truth(spark, d))
    return report.select("image_id", "total_gt", "n_pred", "correct_matches", "class_errors", "false_positives", "missed_gt")


@query
def best_images(spark, d):
    return rounded(diagnose.best_images(_quality(spark, d)), 12)


def _errors(spark: SparkSession, d: str) -> DataFrame:
    reported = write_table(diagnose.report_boxes(standins.detections(spark, d)), "reported")
    return diagnose.image_errors(standins.images(spark, d), reported, standins.truth(spark, d))


@query
def image_errors(spark, d):
    return _errors(spark, d)


@query
def wrong_images(spark, d):
    return diagnose.wrong_images(_errors(spark, d)).select("image_id")


# --- gate ------------------------------------------------------------------------------------------------------------


@query
def gate_kept_tiles(spark, d):
    return gating.kept_tiles(standins.tile_scores(spark, d))


@query
def gate_totals(spark, d):
    return rounded(gating.gate_totals(standins.tile_scores(spark, d)))


@query
def gate_threshold_sweep(spark, d):
    return rounded(gating.threshold_sweep(standins.tile_scores(spark, d)))


@query
def gate_top_tiles(spark, d):
    return gating.top_tiles(standins.tile_scores(spark, d))


@query
def gate_top_k_report(spark, d):
    return rounded(gating.top_k_report(standins.tile_scores(spark, d)))


def _labelled_tiles(spark: SparkSession, d: str) -> DataFrame:
    return gating.tile_labels(standins.tiles(spark, d).select("image_id", "tile_id", "split"), standins.tile_boxes(spark, d))


@query
def tile_object_labels(spark, d):
    return _labelled_tiles(spark, d)


@query
def tile_positive_ratio(spark, d):
    return rounded(gating.positive_ratio(_labelled_tiles(spark, d)))


@query
def first_positive_tiles(spark, d):
    return gating.positive_tiles(_labelled_tiles(spark, d))


@query
def leakage_guard(spark, d):
    tiles = standins.tiles(spark, d).select("image_id", "tile_id")
    # Test tiles: the tiles numbered 3, so images with at least four tiles.
    return gating.without_test_images(tiles, tiles.filter("tile_id = 3"))


@query
def tile_colour_features(spark, d):
    """The features that are plain averages: colour, brightness, patches."""
    plain = [
        "max_red", "max_green", "max_yellow", "max_bright", "top3_red", "top3_green", "bright_ratio",
        "max_patch_brightness", "std_patch_brightness", "upper_bright_ratio",
    ]
    features = extract_features(standins.pixel_tiles(spark, d), ["image_id", "tile_id"])
    return rounded(features.select("image_id", "tile_id", *plain))


@query
def tile_features(spark, d):
    return rounded(extract_features(standins.pixel_tiles(spark, d), ["image_id", "tile_id", "label"]))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return write_table(extract_features(standins.pixel_tiles(spark, d), ["image_id", "tile_id", "label"]), "features")


@query
def gate_standardised_features(spark, d):
    return rounded(standardised(_features(spark, d)))


@query
def gate_class_weights(spark, d):
    return rounded(class_weights(_features(spark, d)))


@query
def gate_scores_fixed_model(spark, d):
    """Scores of a model with given coefficients, one in eight per feature and alternating in sign."""
    coefficients = {f: (1 - 2 * (k % 2)) / 8 for k, f in enumerate(FEATURES)}
    scored = linear_scores(standardised(_features(spark, d)), coefficients, -0.5)
    return rounded(scored.select("image_id", "tile_id", "label", "prob"))


@query
def gate_scores_stored_model(spark, d):
    """The same scores by a model that was saved as a table and loaded again."""
    path = f"{shared_dir(spark)}/boxmill/linear-{uuid.uuid4().hex}"
    save_linear(spark, {f: (1 - 2 * (k % 2)) / 8 for k, f in enumerate(FEATURES)}, -0.5, path)
    scored = linear_scores(standardised(_features(spark, d)), *load_linear(spark, path))
    return rounded(scored.select("image_id", "tile_id", "label", "prob"))


@query
def fitted_gate_optimality(spark, d):
    """Whether the loss is level in every coefficient of the fitted gate: then no other gate has a smaller one."""
    features = _features(spark, d)
    coefficients, intercept = gate_coefficients(fit_gate(features), features.count())
    slopes = loss_gradient(features, coefficients, intercept)
    return slopes.select("feature", (F.abs("gradient") < 1e-4).alias("optimal"))


@query
def image_table_by_split(spark, d):
    """The image table written by split and read back."""
    path = f"{shared_dir(spark)}/boxmill/by-split-{uuid.uuid4().hex}"
    images.write_by_split(standins.images(spark, d), path)
    return spark.read.parquet(path).select("image_id", "split", "width", "height")


@query
def fitted_gate_scores(spark, d):
    return rounded(fit_and_score(standins.pixel_tiles(spark, d))[1], 4)


@query
def fitted_gate_sweep(spark, d):
    return rounded(gating.threshold_sweep(fit_and_score(standins.pixel_tiles(spark, d))[1]))


# --- splits and samples ------------------------------------------------------------------------------------------------


@query
def train_val_split(spark, d):
    return splitting.train_val_split(standins.images(spark, d), F.col("image_id"), seed=7).select("image_id", "subset")


def _scored_tiles(spark: SparkSession, d: str) -> DataFrame:
    return standins.tile_scores(spark, d).select("image_id", "tile_id", "label")


@query
def stratified_split(spark, d):
    return splitting.stratified_split(_scored_tiles(spark, d), F.concat_ws("_tile", "image_id", "tile_id"))


@query
def grouped_split(spark, d):
    return splitting.grouped_split(_scored_tiles(spark, d), "image_id").select("image_id", "tile_id", "subset")


@query
def random_image(spark, d):
    return splitting.random_rows(standins.images(spark, d), F.col("image_id"), n=1, seed=3)


@query
def first_images(spark, d):
    return splitting.first_images(images.list_images(_paths(spark, d)), 25).select("path", "split")


@query
def splits_with_null_keys(spark, d):
    """Rows per subset of splits where every ninth image, label and key is null: no row is lost."""
    nulls = lambda c, k: F.when(F.col("image_id") % k != 0, F.col(c))
    rows = standins.images(spark, d).select(nulls("image_id", 9).alias("id"), nulls("image_id", 5).alias("group"), nulls("split", 7).alias("label"))
    parts = {
        "train_val": splitting.train_val_split(rows, F.col("id")),
        "stratified": splitting.stratified_split(rows, F.col("id")),
        "grouped": splitting.grouped_split(rows, "group"),
    }
    counts = [p.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.count("subset").alias("n_placed")) for k, p in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- runs --------------------------------------------------------------------------------------------------------------


@query
def run_comparison(spark, d):
    return rounded(runs.run_table(standins.run_logs(spark, d)))


@query
def run_kept_delta(spark, d):
    return rounded(runs.kept_delta(runs.run_table(standins.run_logs(spark, d)), "run1", "run2"))


def _stage_times(spark: SparkSession, d: str) -> DataFrame:
    stage = F.get(F.array(*[F.lit(s) for s in runs.STAGES]), (F.col("event_id") % 6).cast("int"))
    return standins.table(spark, d, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run"), stage.alias("stage"),
        ((F.col("event_id") % 40).cast("double") / 4).alias("seconds"),
    )


def _total_times(spark: SparkSession, d: str) -> DataFrame:
    return _stage_times(spark, d).groupBy("run").agg((F.sum("seconds") * F.lit(1.25)).alias("total_time"))


@query
def run_stage_shares(spark, d):
    return rounded(runs.stage_shares(_stage_times(spark, d), _total_times(spark, d)))


@query
def run_throughput(spark, d):
    def stage(name: str):
        return F.coalesce(F.sum(F.when(F.col("stage") == name, F.col("seconds"))), F.lit(0.0))

    recorded = _stage_times(spark, d).groupBy("run").agg(
        F.count(F.lit(1)).alias("images"), (F.count(F.lit(1)) * 3).alias("kept_tiles"),
        stage("io").alias("io_time"), stage("truth").alias("truth_time"),
    ).join(_total_times(spark, d), "run")
    return rounded(runs.throughput(recorded))
