import numpy as np
import pytest

from pyspark.sql import functions as F

from boxmill.functions.cells import searching, waiting
from boxmill.functions.geometry import corners
from boxmill.operators.average_precision import average_precision
from boxmill.operators.matching import IOU_THRESHOLDS, best_truth, match_predictions, overlap_pairs
from boxmill.operators.diagnose import first_matches, image_errors, image_quality
from boxmill.operators.nms import nms
from boxmill.plans.evaluation import evaluate, score_predictions
from tests import loops

DETS = "image_id long, det_id int, cls int, x1 double, y1 double, x2 double, y2 double, conf double"
BOXES = "image_id long, box_id int, cls int, x1 double, y1 double, x2 double, y2 double"


def random_boxes(rng, n, images, classes, span, big=0.1):
    x, y = rng.integers(0, span, (2, n))
    side = np.where(rng.random(n) < big, 400, 60)
    w, h = (rng.integers(10, 10 + side) for _ in range(2))
    return [
        {"image_id": int(i), "cls": int(c), "x1": float(a), "y1": float(b), "x2": float(a + p), "y2": float(b + q)}
        for i, c, a, b, p, q in zip(rng.integers(0, images, n), rng.integers(0, classes, n), x, y, w, h)
    ]


def detections(rng, n, images=3, classes=2, span=200, levels=50):
    rows = random_boxes(rng, n, images, classes, span)
    return [dict(r, det_id=k, conf=float(rng.integers(1, levels)) / levels) for k, r in enumerate(rows)]


def truth_boxes(rng, n, images=3, classes=2, span=200):
    return [dict(r, box_id=k) for k, r in enumerate(random_boxes(rng, n, images, classes, span))]


def dets_frame(spark, rows):
    names = [f.split()[0] for f in DETS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], DETS)


def boxes_frame(spark, rows):
    names = [f.split()[0] for f in BOXES.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], BOXES)


def ids(rows):
    return sorted((r["image_id"], r["det_id"]) for r in rows)


@pytest.mark.parametrize("agnostic", [False, True])
@pytest.mark.parametrize("max_det", [300, 7, None])
@pytest.mark.parametrize("array_rows", [1000, 20, 1])
def test_nms_equals_loop(spark, agnostic, max_det, array_rows):
    rows = detections(np.random.default_rng(5), 400)
    kept = nms(dets_frame(spark, rows), 0.4, max_det, agnostic, array_rows=array_rows).collect()
    assert ids(kept) == ids(loops.nms(rows, 0.4, max_det, agnostic))


def test_nms_limit_of_300(spark):
    rng = np.random.default_rng(6)
    rows = [dict(r, image_id=1) for r in detections(rng, 900, span=3000, classes=2, levels=1000)]
    expected = loops.nms(rows, 0.5)
    assert len(expected) == 300
    for array_rows in (1000, 150):
        assert ids(nms(dets_frame(spark, rows), array_rows=array_rows).collect()) == ids(expected)


def test_nms_of_copies_in_one_image(spark):
    # One image holds most rows, nearly all of them copies of two boxes.
    rng = np.random.default_rng(7)
    rows = detections(rng, 60, images=4)
    rows += [dict(rows[k % 2], image_id=9, det_id=1000 + k, conf=float(rng.integers(1, 9)) / 10) for k in range(500)]
    kept = nms(dets_frame(spark, rows), array_rows=50).collect()
    assert ids(kept) == ids(loops.nms(rows, 0.5))


@pytest.mark.parametrize("agnostic", [False, True])
@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.5])
def test_nms_of_ties_and_missing_scores_is_the_same_in_regions(spark, agnostic, threshold):
    """Null and NaN scores, numbers that repeat, equal rows, null images and broken boxes: one order for both ways."""
    rng = np.random.default_rng(11)
    rows = detections(rng, 250, images=2, levels=6)
    for k, r in enumerate(rows):
        r["det_id"] = k % 9
        r["conf"] = None if k % 7 == 0 else float("nan") if k % 5 == 0 else r["conf"]
        r["image_id"] = None if k % 11 == 0 else r["image_id"]
    rows += [dict(r) for r in rows[::8]]
    rows += [dict(rows[0], x2=float("inf")), dict(rows[1], x1=float("nan")), dict(rows[2], y2=rows[2]["y1"]), dict(rows[3], x2=2.0e6, y2=2.0e6)]
    df = dets_frame(spark, rows)
    whole = sorted(map(repr, nms(df, threshold, None, agnostic).collect()))
    for array_rows in (2, 100):
        assert sorted(map(repr, nms(df, threshold, None, agnostic, array_rows=array_rows).collect())) == whole


def test_nms_of_far_boxes_loses_none(spark):
    for conf in (0.5, None, float("nan")):
        rows = [dict(image_id=1, det_id=1, cls=0, x1=100.0 * k, y1=0.0, x2=100.0 * k + 9, y2=9.0, conf=conf) for k in range(5)]
        for array_rows in (1000, 2):
            assert nms(dets_frame(spark, rows), array_rows=array_rows).count() == 5


def test_huge_boxes_cost_few_rows(spark):
    preds = [dict(image_id=1, det_id=k, cls=0, x1=0.0, y1=0.0, x2=side, y2=side, conf=0.5) for k, side in enumerate((1.5e6, 3.0e10, 60.0, float("inf"), float("nan"), 9.0e15))]
    truth = [dict(image_id=1, box_id=k, cls=0, x1=0.0, y1=0.0, x2=side, y2=side) for k, side in enumerate((1.4e6, 2.5e10, 55.0, 8.0))]
    pairs = overlap_pairs(dets_frame(spark, preds), boxes_frame(spark, truth), 0.5).collect()
    assert sorted((r["det_id"], r["box_id"]) for r in pairs) == [(0, 0), (1, 1), (2, 2)]
    box = corners()
    for side in (searching, waiting):
        rows = side(dets_frame(spark, preds), box, 0.5).groupBy("det_id").count()
        assert rows.agg(F.max("count")).first()[0] < 10


def test_meeting_costs_few_rows(spark):
    """Fewer than three rows for a detection, two for a truth box."""
    rng = np.random.default_rng(21)
    preds, truth = detections(rng, 2000, images=50, span=1500), truth_boxes(rng, 2000, images=50, span=1500)
    box = corners()
    assert searching(dets_frame(spark, preds), box, 0.5).count() < 3 * 2000
    assert waiting(boxes_frame(spark, truth), box, 0.5).count() <= 2 * 2000


def test_detection_key(spark):
    """Equal numbers in different tiles are two detections; the same key twice fails."""
    pred = dict(image_id=1, det_id=1, cls=0, x1=0.0, y1=0.0, x2=9.0, y2=9.0, conf=0.5)
    truth = boxes_frame(spark, [dict(image_id=1, box_id=1, cls=0, x1=0.0, y1=0.0, x2=9.0, y2=9.0)])
    twice = dets_frame(spark, [pred, pred])
    tiles = twice.limit(1).withColumn("tile_id", F.lit(1)).unionByName(twice.limit(1).withColumn("tile_id", F.lit(2)))
    rows = match_predictions(tiles, truth).collect()
    assert sorted((r["tile_id"], r["hits"] & 1) for r in rows) == [(1, 1), (2, 0)]
    with pytest.raises(Exception, match="two detections share"):
        match_predictions(twice, truth).collect()


def test_nms_keeps_iou_equal_to_threshold(spark):
    a = dict(image_id=1, det_id=1, cls=0, x1=0.0, y1=0.0, x2=10.0, y2=10.0, conf=0.9)
    b = dict(a, det_id=2, x2=5.0, conf=0.8)
    assert len(nms(dets_frame(spark, [a, b]), 0.5).collect()) == 2
    assert len(nms(dets_frame(spark, [a, b]), 0.49).collect()) == 1


def test_nms_twice_changes_nothing(spark):
    once = nms(dets_frame(spark, detections(np.random.default_rng(8), 200)))
    assert ids(nms(once).collect()) == ids(once.collect())


@pytest.mark.parametrize("min_iou", [0.1, 0.3, 0.5, 0.8])
def test_pairs_equal_loop(spark, min_iou):
    rng = np.random.default_rng(9)
    preds, truth = detections(rng, 150, span=900), truth_boxes(rng, 150, span=900)
    preds += [dict(t, det_id=1000 + t["box_id"], conf=0.5, x1=t["x1"] - 20, y2=t["y2"] + 9) for t in truth]
    found = overlap_pairs(dets_frame(spark, preds), boxes_frame(spark, truth), min_iou, same_class=False).collect()
    expected = {
        (p["image_id"], p["det_id"], t["box_id"])
        for p in preds for t in truth
        if p["image_id"] == t["image_id"] and loops.iou(loops.box(p), loops.box(t)) >= min_iou
    }
    assert {(r["image_id"], r["det_id"], r["box_id"]) for r in found} == expected
    assert len(found) == len(expected)


def noisy(rng, truth):
    rows = []
    for t in truth:
        for _ in range(int(rng.integers(0, 3))):
            d = rng.integers(-5, 6, 4).tolist()
            rows.append(dict(t, det_id=len(rows), conf=float(rng.integers(1, 12)) / 12, x1=t["x1"] + d[0], y1=t["y1"] + d[1], x2=t["x2"] + d[2], y2=t["y2"] + d[3]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_evaluation_equals_loop(spark, seed):
    rng = np.random.default_rng(seed)
    truth = truth_boxes(rng, 120, images=8, classes=3, span=400)
    preds = noisy(rng, truth)
    # A class only predicted, and one without any prediction.
    preds += [dict(preds[0], det_id=5000, cls=7)]
    truth += [dict(truth[0], box_id=5000, cls=9)]
    expected, table = loops.evaluate(loops.nms(preds, 0.9), truth, IOU_THRESHOLDS)
    row = evaluate(dets_frame(spark, preds), boxes_frame(spark, truth), nms_iou=0.9).collect()[0]
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-9)
    assert row["classes_evaluated"] == 5
    order, counts = score_predictions(nms(dets_frame(spark, preds), 0.9), boxes_frame(spark, truth))
    ap = {(r["cls"], r["iou_thr"]): r["ap"] for r in average_precision(order, counts).collect()}
    assert ap == pytest.approx(table, abs=1e-9)
    assert ap[9, 0.5] == 0.0


def test_prediction_without_truth_is_no_hit(spark):
    # A null box must not count as a large overlap.
    preds = [dict(image_id=1, det_id=1, cls=0, x1=0.0, y1=0.0, x2=9.0, y2=9.0, conf=0.9)]
    truth = [dict(image_id=2, box_id=1, cls=0, x1=0.0, y1=0.0, x2=9.0, y2=9.0)]
    row = match_predictions(dets_frame(spark, preds), boxes_frame(spark, truth)).collect()[0]
    assert row["hits"] == 0 and row["best_iou"] is None


def test_no_second_choice(spark):
    # Both predictions prefer box 1; the second one does not fall back to box 2.
    truth = [
        dict(image_id=1, box_id=1, cls=0, x1=0.0, y1=0.0, x2=10.0, y2=10.0),
        dict(image_id=1, box_id=2, cls=0, x1=3.0, y1=0.0, x2=13.0, y2=10.0),
    ]
    preds = [
        dict(image_id=1, det_id=1, cls=0, x1=0.0, y1=0.0, x2=10.0, y2=10.0, conf=0.9),
        dict(image_id=1, det_id=2, cls=0, x1=1.0, y1=0.0, x2=11.0, y2=10.0, conf=0.8),
    ]
    hits = {r["det_id"]: r["hits"] & 1 for r in match_predictions(dets_frame(spark, preds), boxes_frame(spark, truth)).collect()}
    assert hits == {1: 1, 2: 0}


def test_empty_inputs(spark):
    truth = truth_boxes(np.random.default_rng(3), 10)
    none = dets_frame(spark, [])
    row = evaluate(none, boxes_frame(spark, truth)).collect()[0]
    assert (row["precision"], row["recall"], row["map50"], row["map50_95"]) == (0, 0, 0, 0)
    row = evaluate(dets_frame(spark, detections(np.random.default_rng(4), 20)), boxes_frame(spark, [])).collect()[0]
    assert (row["precision"], row["recall"], row["map50"], row["map50_95"]) == (0, 0, 0, 0)


def test_scores_have_one_order(spark):
    """NaN scores come after numbers and null ones last, in matching and in the quality report."""
    box = dict(image_id=1, cls=0, x1=0.0, y1=0.0, x2=10.0, y2=10.0)
    truth = boxes_frame(spark, [dict(box, box_id=1)])
    preds = [dict(box, det_id=0, conf=None, cls=1), dict(box, det_id=1, conf=float("nan")), dict(box, det_id=2, conf=0.1), dict(box, det_id=3, conf=0.9)]
    hits = {r["det_id"]: r["hits"] & 1 for r in match_predictions(dets_frame(spark, preds[1:]), truth).collect()}
    assert hits == {1: 0, 2: 0, 3: 1}
    for n, best in ((4, 3), (3, 2), (2, 1), (1, 0)):
        assert first_matches(dets_frame(spark, preds[:n]), truth).first()["det_id"] == best


def test_quality_of_detections_numbered_per_tile(spark):
    """Two tiles, both with a detection number 0, each exactly on its truth box."""
    a, b = dict(image_id=1, cls=0, x1=0.0, y1=0.0, x2=10.0, y2=10.0), dict(image_id=1, cls=0, x1=50.0, y1=0.0, x2=60.0, y2=10.0)
    preds = dets_frame(spark, [dict(a, det_id=0, conf=0.9), dict(b, det_id=0, conf=0.8)])
    preds = preds.withColumn("tile_id", (F.col("x1") > 20).cast("int"))
    truth = boxes_frame(spark, [dict(a, box_id=0), dict(b, box_id=1)])
    images = spark.createDataFrame([(1,)], "image_id long")
    quality = image_quality(images, preds, truth).first()
    assert (quality["correct_matches"], quality["false_positives"], quality["missed_gt"]) == (2, 0, 0)
    errors = image_errors(images, preds, truth).first()
    assert (errors["missed_gt"], errors["unused_preds"]) == (0, 0)


def test_chains_across_regions(spark):
    """A long row of boxes that each suppress the next, over many borders: every second one stays."""
    rows = [dict(image_id=1, det_id=k, cls=0, x1=20.0 * k, y1=0.0, x2=20.0 * k + 60, y2=60.0, conf=1 - k / 1000) for k in range(300)]
    kept = nms(dets_frame(spark, rows), 0.4, None, array_rows=10).collect()
    assert ids(kept) == [(1, k) for k in range(0, 300, 2)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordinary_images_meet_without_cells(spark):
    rng = np.random.default_rng(9)
    preds, boxes = dets_frame(spark, detections(rng, 200, images=9)), boxes_frame(spark, truth_boxes(rng, 120, images=9))
    # A null image, a box without area, and corners that are no numbers.
    preds = preds.withColumns({"image_id": F.expr("nullif(image_id, 3)"), "x2": F.expr("if(det_id % 17 = 0, x1, x2)"), "y1": F.expr("if(det_id % 19 = 0, double('NaN'), y1)")})
    boxes = boxes.withColumns({"image_id": F.expr("nullif(image_id, 3)"), "x1": F.expr("if(box_id % 13 = 0, null, x1)")})
    for limit in (0, 15):
        for find in (overlap_pairs, best_truth):
            near, far = (find(preds, boxes, 0.3, meeting_rows=n) for n in (1000, limit))
            assert "cell_x" not in plan_of(near) and "cell_x" in plan_of(far)
            assert sorted(map(repr, near.collect())) == sorted(map(repr, far.collect()))


def test_repeated_detection_fails_in_ordinary_images(spark):
    row = {"image_id": 1, "det_id": 1, "cls": 0, "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 9.0, "conf": 0.5}
    for boxes in ([], [dict(row, box_id=1)]):
        with pytest.raises(Exception, match="share image"):
            best_truth(dets_frame(spark, [row, row]), boxes_frame(spark, boxes), 0.5).collect()
    # Boxes with the same number are no fault.
    same = boxes_frame(spark, [dict(row, box_id=1)] * 2)
    assert best_truth(dets_frame(spark, [row]), same, 0.5).count() == 1
