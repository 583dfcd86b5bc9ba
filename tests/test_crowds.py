"""What crowded images leave on the disks, and that boxes of all sizes still meet."""

import glob
import os
import time

import numpy as np
from pyspark.sql import functions as F

from boxmill import session
from boxmill.functions.cells import searching, waiting
from boxmill.functions.geometry import corners
from boxmill.operators import diagnose
from boxmill.operators import nms as nms_module
from boxmill.operators.matching import overlap_pairs
from boxmill.operators.nms import nms
from boxmill.operators.ranking import group_sizes, split_large
from tests import loops
from tests.test_detections import boxes_frame, detections, dets_frame, ids, plan_of, truth_boxes


def sized_boxes(rng, n):
    """Boxes of all sizes from 3 to 6,000 pixels, half of them close to an earlier one."""
    rows = []
    for k in range(n):
        if k % 2:
            other = rows[int(rng.integers(0, len(rows)))]
            w, h = other["x2"] - other["x1"], other["y2"] - other["y1"]
            x, y = other["x1"] + w * rng.uniform(-0.4, 0.4), other["y1"] + h * rng.uniform(-0.4, 0.4)
            w, h = (side * 2 ** rng.uniform(-1.5, 1.5) for side in (w, h))
        else:
            (x, y), (w, h) = rng.uniform(0, 9000, 2), 2 ** rng.uniform(1.6, 12.5, 2)
        rows.append({"image_id": 1, "det_id": k, "cls": int(k % 3 == 0), "x1": float(x), "y1": float(y), "x2": float(x + w), "y2": float(y + h)})
    return rows


def test_boxes_of_all_sizes_meet_in_regions_and_cells(spark):
    rng = np.random.default_rng(21)
    rows = [dict(r, conf=float(rng.integers(1, 40)) / 40) for r in sized_boxes(rng, 200)]
    for threshold in (0.01, 0.4):
        kept = nms(dets_frame(spark, rows), threshold, None, True, array_rows=20).collect()
        assert ids(kept) == ids(loops.nms(rows, threshold, None, True))
    preds, boxes = dets_frame(spark, rows), boxes_frame(spark, [dict(r, box_id=r["det_id"] % 150) for r in rows[::-2]])
    near, far = (sorted(map(repr, overlap_pairs(preds, boxes, 0.2, same_class=False, meeting_rows=n).collect())) for n in (1000, 0))
    assert near == far and len(near) > 100


def test_rows_of_crowds_pass_their_region_once(spark, monkeypatch):
    """Rows are stored when they are kept: not before, and nothing is joined or shuffled afterwards."""
    names, write = [], nms_module.write_table
    monkeypatch.setattr(nms_module, "write_table", lambda df, name: names.append(name) or write(df, name))
    rows = detections(np.random.default_rng(22), 1500, images=1, span=9000, levels=1000)
    kept = nms(dets_frame(spark, rows).withColumn("note", F.concat(F.lit("of "), "det_id")), 0.5, None, array_rows=10)
    assert names[0] == "nms-fates" and set(names) <= {"nms-fates", "nms-regions"}
    assert "Join" not in plan_of(kept) and "Exchange" not in plan_of(kept)
    found = kept.collect()
    assert ids(found) == ids(loops.nms(rows, 0.5, None)) and all(r["note"] == f"of {r['det_id']}" for r in found)


def test_equal_rows_and_rows_that_meet_nothing_in_regions(spark):
    box = dict(image_id=1, cls=0, x1=0.0, y1=0.0, x2=60.0, y2=60.0)
    rows = [dict(box, det_id=1, conf=0.9)] * 4 + [dict(box, det_id=2, conf=0.9), dict(box, det_id=3, conf=0.8, cls=None)]
    rows += [dict(box, det_id=4, conf=0.1, x2=None)] * 3 + [dict(box, det_id=5, conf=None, x2=0.0)] * 2
    for agnostic in (False, True):
        near, far = (sorted(map(repr, nms(dets_frame(spark, rows), 0.5, None, agnostic, array_rows=n).collect())) for n in (1000, 2))
        assert near == far and len(near) == (6 if agnostic else 7)


def test_boxes_of_one_size_lie_in_few_cells(spark):
    rows = [dict(image_id=1, det_id=k, cls=0, x1=97.0 * k, y1=61.0 * k, x2=97.0 * k + 50 + k % 40, y2=61.0 * k + 60, conf=0.5) for k in range(1000)]
    df = dets_frame(spark, rows)
    assert searching(df, corners(), 0.5).count() < 1500 and waiting(df, corners(), 0.5).count() == 1000


def test_error_report_stores_narrow_pairs(spark, monkeypatch):
    """So that the wider rows that met are off the disks when the pairs are summed up."""
    stored, write = [], diagnose.write_table
    monkeypatch.setattr(diagnose, "write_table", lambda df, name: stored.append(df.columns) or write(df, name))
    rng = np.random.default_rng(23)
    preds, truth = detections(rng, 900, images=2, span=900), truth_boxes(rng, 700, images=2, span=900)
    images = spark.createDataFrame([(0,), (1,), (2,)], "image_id long")
    rows = diagnose.image_errors(images, dets_frame(spark, preds), boxes_frame(spark, truth)).collect()
    assert stored == [["image_id", "box_id", "det_id", "mixed"]]
    expected = {}
    for i in range(3):
        mine, boxes = ([r for r in side if r["image_id"] == i] for side in (preds, truth))
        pairs = [(p["det_id"], t["box_id"], p["cls"] != t["cls"]) for p in mine for t in boxes if loops.iou(loops.box(p), loops.box(t)) >= 0.5]
        expected[i] = (len(boxes) - len({b for _, b, _ in pairs}), sum(m for _, _, m in pairs), len(mine) - len({d for d, _, _ in pairs}))
    assert {r["image_id"]: (r["missed_gt"], r["class_conflicts"], r["unused_preds"]) for r in rows} == expected


def test_groups_that_are_all_large_are_not_looked_through_again(spark):
    rows = spark.createDataFrame([(k, n) for k in (1, None) for n in range(4)], "k int, n int")
    small, large = split_large(rows, ["k"], 3)
    assert "Join" not in plan_of(small) + plan_of(large) and small.count() == 0 and large.count() == 8
    more = rows.unionByName(spark.createDataFrame([(2, 0)], "k int, n int"))
    small, large = split_large(more, ["k"], 3)
    assert [tuple(r) for r in small.collect()] == [(2, 0)] and large.count() == 8
    assert group_sizes(more, ["k"], 9) == (None, True) and group_sizes(more.limit(0), ["k"], 9) == (None, False)
    # Keys that cannot be null.
    known = spark.range(3).union(spark.range(1))
    assert not known.schema["id"].nullable and [t.count() for t in split_large(known, ["id"], 1)] == [2, 2]


def test_groups_too_many_to_be_listed(spark, monkeypatch):
    monkeypatch.setattr(session, "MAX_LISTED_ROWS", 1)
    rows = spark.createDataFrame([(k, n) for k in (1, None) for n in range(4)] + [(2, 0)], "k int, n int")
    small, large = split_large(rows, ["k"], 3)
    assert [tuple(r) for r in small.collect()] == [(2, 0)] and large.count() == 8


def test_stored_tables_leave_no_shuffles(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffled():
        files = [f for folder in folders for f in glob.glob(f"{folder.getPath()}/*/shuffle_*.data")]
        return {f for f in files if os.path.exists(f) and os.path.getsize(f)}

    before, setting = shuffled(), spark.conf.get(session.SHUFFLE_CLEANUP, None)
    stored = session.write_table(spark.range(100_000).repartition(5, "id"), "shuffled")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and stored.count() == 100_000
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == setting
