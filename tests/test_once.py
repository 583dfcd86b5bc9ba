"""Costly columns are computed once, however many filters use them: seen in the optimised plan."""

from pyspark.sql import functions as F

from boxmill.operators.matching import overlap_pairs
from boxmill.operators.tiling import fixed_tile_boxes, stitch
from boxmill.sources.labels import parse_label_lines

CORNERS = ("x1", "y1", "x2", "y2")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def boxes(spark):
    """Boxes whose corners are computed; ``id`` is what they are made of."""
    values = {c: (F.col("id") * 37 % 100 + 50 * (c[1] == "2")).cast("double") for c in CORNERS}
    fixed = {"image_id": F.col("id"), "box_id": F.col("id"), "det_id": F.col("id"), "cls": F.lit(0), "conf": F.lit(0.5)}
    return spark.range(20).withColumns(fixed | {"width": F.col("id").cast("int") + 1500, "height": F.col("id").cast("int") + 900} | values)


def test_each_part_of_a_line_is_matched_once(spark):
    lines = spark.createDataFrame([("0 1 2 3 4",), ("1.5 .5 1. 1e2 +3",), ("0 1 2 3",), ("0 1 2 3 x",), ("3000000000 1 2 3 4",), (None,), ("",)], "line string")
    for strict in (False, True):
        assert plan(parse_label_lines(lines.withColumn("line", F.trim("line")), strict)).upper().count("RLIKE") == 5
    assert sorted(map(tuple, parse_label_lines(lines).collect())) == [(0, 1.0, 2.0, 3.0, 4.0), (1, 0.5, 1.0, 100.0, 3.0)]


def test_a_cut_is_computed_once(spark):
    found = fixed_tile_boxes(boxes(spark), carry=("width", "height"))
    assert plan(found).count("640") <= 60
    assert found.count() == 20 and stitch(found).count() == found.count()


def test_cells_are_computed_once(spark):
    found = overlap_pairs(boxes(spark), boxes(spark), 0.5)
    assert plan(found).count("* 37") <= 16
    assert found.count() == 20
