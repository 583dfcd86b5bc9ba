"""Plan shapes: what must not shuffle, and what must be pushed into the scan."""

import re

import pytest
from pyspark.sql import functions as F

from boxmill import session
from boxmill.operators import average_precision as ap
from boxmill.operators import ranking, tiling
from boxmill.operators.gating import threshold_sweep, top_tiles
from boxmill.operators.nms import nms
from boxmill.sources.labels import parse_label_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    n = spark.range(4000)
    spot = [(F.col("id") * k % 500).cast("double").alias(c) for k, c in ((7, "x1"), (13, "y1"))]
    boxes = n.select(
        (F.col("id") % 300).alias("image_id"), F.col("id").cast("int").alias("box_id"), (F.col("id") % 3).cast("int").alias("cls"), *spot,
        F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit("unused").alias("note"),
    ).withColumn("x2", F.col("x1") + 40).withColumn("y2", F.col("y1") + 30)
    boxes.write.parquet(str(folder / "boxes"))
    dets = boxes.select("image_id", F.col("box_id").alias("det_id"), "cls", "x1", "y1", "x2", "y2", (F.col("box_id") % 97 / 97).alias("conf"))
    dets.write.parquet(str(folder / "dets"))
    scores = boxes.select("image_id", F.col("box_id").alias("tile_id"), (F.col("box_id") % 10 / 10).alias("prob"), F.lit(1).alias("label"))
    scores.write.parquet(str(folder / "scores"))
    return {name: spark.read.parquet(str(folder / name)) for name in ("boxes", "dets", "scores")}


def test_cutting_boxes_needs_no_shuffle(stored):
    cut = tiling.fixed_tile_boxes(stored["boxes"])
    assert shuffles(cut) == 0 and "Join" not in plan(cut)
    assert "note" not in plan(cut)


def test_tile_grid_needs_no_shuffle(stored):
    assert shuffles(tiling.fixed_tiles(stored["boxes"].select("image_id", "width", "height"))) == 0


def test_nms_of_ordinary_images_shuffles_once(stored):
    """Apart from the count of rows per image, which is a small job of its own while the plan is built."""
    kept = nms(stored["dets"])
    assert shuffles(kept) == 1 and "Window" not in plan(kept) and "Python" not in plan(kept)


def test_sweep_is_one_pass(stored):
    assert plan(threshold_sweep(stored["scores"])).count("Scan parquet") == 1
    assert shuffles(threshold_sweep(stored["scores"])) == 0


def test_top_tiles_are_cut_before_the_shuffle(stored):
    text = plan(top_tiles(stored["scores"]))
    assert text.count("WindowGroupLimit") == 2 and shuffles(top_tiles(stored["scores"])) == 1


def test_stitching_needs_no_join(stored):
    back = tiling.stitch(tiling.fixed_tile_boxes(stored["boxes"], carry=("width", "height")))
    assert shuffles(back) == 0 and "Join" not in plan(back)


@pytest.fixture(scope="module")
def matched(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("matched") / "rows")
    n = F.col("id")
    spark.range(3000).select(
        (n % 40).alias("image_id"), n.alias("det_id"), (n % 3).cast("int").alias("cls"), (n * 37 % 1000 / 1000).alias("conf"),
        (F.pow(F.lit(2.0), n * 7 % 11) - 1).cast("int").alias("hits"),
    ).write.parquet(folder)
    return spark.read.parquet(folder)


def test_curve_reads_the_sorted_rows_once(spark, matched, monkeypatch):
    """Two stored tables, one scan, one shuffle of the true positives; 14 jobs where a stored curve took 20."""
    names = []
    write = session.write_table
    for module in (ap, ranking):
        monkeypatch.setattr(module, "write_table", lambda df, name: names.append(name) or write(df, name))
    counts = spark.createDataFrame([(c, 900) for c in range(4)], "cls int, n_gt long").coalesce(1)
    spark.sparkContext.setJobGroup("curve", "curve")
    try:
        scores = ap.average_precision(ap.ScoreOrder(matched), counts)
        assert scores.count() == 40
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("curve")
        spark.sparkContext._jsc.clearJobGroup()
    assert names == ["matched", "sorted"] and len(jobs) <= 15
    scores.collect()
    final = plan(scores).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("listed", [20_000, 1])
def test_curve_over_many_files_equals_a_plain_walk(spark, matched, monkeypatch, listed):
    """Classes spread over several files; the second case has totals too long to be listed, which are joined by shuffle."""
    monkeypatch.setattr(session, "MAX_LISTED_ROWS", listed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = ap.ScoreOrder(matched)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert order.totals.count() > 3
    found = {(r["cls"], r["iou_thr"], r["rank"]): (r["tp_cum"], r["precision"], r["envelope"]) for r in order.curve().collect()}
    rows = sorted(matched.collect(), key=lambda r: (r["cls"], -r["conf"], r["image_id"], r["det_id"]))
    expected = {}
    for cls in range(3):
        mine = [r for r in rows if r["cls"] == cls]
        for k, threshold in enumerate(order.thresholds):
            tp, walk = 0, []
            for rank, row in enumerate(mine, 1):
                if row["hits"] >> k & 1:
                    tp += 1
                    walk.append((rank, tp, tp / (rank + ap.EPS)))
            best = 0.0
            for rank, tp, precision in reversed(walk):
                best = max(best, precision)
                expected[cls, threshold, rank] = (tp, precision, best)
    assert found == expected


def test_curve_of_nothing_is_empty(spark, matched):
    counts = spark.createDataFrame([(0, 5)], "cls int, n_gt long")
    order = ap.ScoreOrder(matched.limit(0))
    assert order.curve().count() == 0 and order.class_counts().count() == 0
    assert {r["ap"] for r in ap.average_precision(order, counts).collect()} == {0.0}


def test_nms_collects_a_plain_column(stored):
    """What a collecting aggregate computes itself is interpreted row by row."""
    assert "collect_list(packed_" in plan(nms(stored["dets"]))


def test_a_label_line_takes_one_pattern(spark):
    """One pattern for lines with plain blanks, one for the others, where there was one per number."""
    lines = spark.createDataFrame([("0 .5 1. 5e-1 +0.5",), ("\t1\t.5  1 1 1 ",), ("0 1 1 1",), ("0 1 1 1 1 1",), ("0 1 1 1 1e",), ("",)], "line string")
    boxes = parse_label_lines(lines)
    assert plan(boxes).split("== Initial Plan ==")[0].count(" RLIKE ") + plan(boxes).count("rlike(") <= 2
    assert sorted(map(tuple, boxes.collect())) == [(0, 0.5, 1.0, 0.5, 0.5), (1, 0.5, 1.0, 1.0, 1.0)]
