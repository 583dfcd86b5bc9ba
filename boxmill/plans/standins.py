"""Detection tables derived from the benchmark tables by exact integer arithmetic (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxmill.functions.geometry import CORNERS
from boxmill.operators.tiling import fixed_tile_boxes, fixed_tiles

CLASS_COUNT = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, split, width, height``: one row per order."""
    key = F.col("o_orderkey")
    digit = key % 10
    return table(spark, sf_dir, "orders").select(
        key.alias("image_id"),
        F.when(digit < 7, "train").when(digit < 8, "val").otherwise("test").alias("split"),
        (480 + 160 * (key % 9)).cast("int").alias("width"),
        (400 + 120 * (F.col("o_custkey") % 6)).cast("int").alias("height"),
    )


def _truth_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k1"),
        F.col("l_suppkey").alias("k2"), "l_quantity", "l_extendedprice", "l_shipdate",
    )
    order = [F.col(c) for c in ("n", "k1", "k2", "l_quantity", "l_extendedprice", "l_shipdate")]
    # A plain window: an order has a handful of lines, and counting them first would be a job of its own in every query.
    numbered = lines.withColumn("box_id", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)))
    boxes = numbered.join(images(spark, sf_dir), "image_id")
    k1, k2, n = F.col("k1"), F.col("k2"), F.col("n")
    return (
        boxes.withColumn("k3", F.col("l_quantity").cast("long"))
        .withColumn("cls", (k1 % CLASS_COUNT).cast("int"))
        .withColumn("x1", (k1 * 37 + k2 * 101 + n * 53) % (F.col("width") - 100))
        .withColumn("y1", (k1 * 59 + k2 * 17 + n * 71) % (F.col("height") - 100))
        .withColumn("x2", F.col("x1") + 12 + (k1 * 7 + n * 13) % 61)
        .withColumn("y2", F.col("y1") + 20 + (k2 * 11 + n * 5 + k1) % 73)
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, split, width, height, box_id, cls, x1, y1, x2, y2``: one row per line item."""
    return _truth_with_keys(spark, sf_dir).select("image_id", "split", "width", "height", "box_id", "cls", *_as_double())


def _as_double() -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in CORNERS]


def detections(spark: SparkSession, sf_dir: str, carry: Sequence[str] = ()) -> DataFrame:
    """``image_id, det_id, cls, x1, y1, x2, y2, conf``: jittered copies of truth boxes plus shifted false ones."""
    base = _truth_with_keys(spark, sf_dir)
    k1, k2, k3, box, dup = (F.col(c) for c in ("k1", "k2", "k3", "box_id", "dup"))
    none = F.array().cast("array<int>")
    near = F.when(k3 % 8 == 0, none).when(k1 % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    false = F.when(k3 % 6 == 0, F.array(F.lit(2))).otherwise(none)
    # dup 0 and 1 are jittered copies, dup 2 is the shifted box: one pass instead of a union.
    shifted = dup == 2

    def pick(when_shifted: Column, otherwise: Column) -> Column:
        return F.when(shifted, when_shifted).otherwise(otherwise)

    x1, y1, x2, y2, cls = (F.col(c) for c in ("x1", "y1", "x2", "y2", "cls"))
    score = pick(
        (k1 * 17 + k3 * 29) % 400 + 250, (k1 * 131 + k2 * 197 + k3 * 89 + box * 41 + dup * 333) % 700 + 300
    )
    return (
        base.withColumn("dup", F.explode(F.concat(near, false)))
        .select(
            "image_id",
            pick(box + 1000, box * 2 + dup).alias("det_id"),
            F.when(~shifted & (k3 % 9 == 0), (cls + 1) % CLASS_COUNT).otherwise(cls).alias("cls"),
            pick(x1 + 60, x1 + (k2 * 3 + dup * 4) % 7 - 3).alias("x1"),
            pick(y1 + 40, y1 + (k1 * 5 + dup * 3) % 7 - 3).alias("y1"),
            pick(x2 + 60, x2 + (k1 * 3 + dup * 5) % 9 - 4).alias("x2"),
            pick(y2 + 40, y2 + (k3 * 3 + dup) % 9 - 4).alias("y2"),
            (score.cast("double") / F.lit(1000.0)).alias("conf"),
            *carry,
        )
        .select("image_id", "det_id", "cls", *_as_double(), "conf", *carry)
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed grid of every image."""
    return fixed_tiles(images(spark, sf_dir))


def tile_boxes(spark: SparkSession, sf_dir: str, carry: Sequence[str] = ()) -> DataFrame:
    """Truth boxes cut by the fixed grid."""
    return fixed_tile_boxes(truth(spark, sf_dir), carry=carry)


def tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, tile_id, prob, label``: a score for every fixed tile, higher for tiles with a box."""
    labelled = tile_boxes(spark, sf_dir).select("image_id", "tile_id").distinct().withColumn("label", F.lit(1))
    scored = tiles(spark, sf_dir).select("image_id", "tile_id").join(labelled, ["image_id", "tile_id"], "left")
    label = F.coalesce("label", F.lit(0))
    points = (F.col("image_id") * 37 + F.col("tile_id") * 211) % 600 + 350 * label
    return scored.select("image_id", "tile_id", (points.cast("double") / F.lit(1000.0)).alias("prob"), label.alias("label"))


def pixel_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, tile_id, label, height, width, data``: an 8x8 BGR tile per embedding, four tiles to an image."""
    values = F.transform(
        "embedding",
        lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") * 2 + F.lit(0.5)) * 255))).cast("int"),
    )
    bgr = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.array(*[F.get("v", (i + offset) % 64) for offset in (0, 21, 42)]),
        )
    )
    hexes = F.array_join(F.transform(bgr, lambda b: F.lpad(F.hex(b), 2, "0")), "")
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("v", values)
        .select(
            F.floor(F.col("vec_id") / 4).alias("image_id"),
            (F.col("vec_id") % 4).cast("int").alias("tile_id"),
            (F.col("label") < 3).cast("int").alias("label"),
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            F.unhex(hexes).alias("data"),
        )
    )


# Label texts of the stand-in annotations, by l_suppkey % 10.
LABEL_TEXTS = (
    "red", "Yellow", "GreenLeft", "off", "RedStraight", "yellow_blinking", "GREEN ARROW", "Switched-Off", "pedestrian", "RedLeft",
)


def annotation_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotation documents, one box per document.

    The box form goes by line number, the label key by ``l_partkey``, the label text by ``l_suppkey``.
    """
    base = _truth_with_keys(spark, sf_dir).withColumn("file", F.concat_ws("_", "image_id", "box_id"))
    corner = [F.col(c).cast("string") for c in CORNERS]
    a, b, c, d = corner
    direct = F.concat(F.lit('"x_min":'), a, F.lit(',"y_min":'), b, F.lit(',"x_max":'), c, F.lit(',"y_max":'), d)
    points = F.concat(F.lit('"points":{"exterior":[['), c, F.lit(","), b, F.lit("],["), a, F.lit(","), d, F.lit("]]}"))
    as_list = F.concat(F.lit('"bbox":['), a, F.lit(","), b, F.lit(","), c, F.lit(","), d, F.lit("]"))
    as_dict = F.concat(F.lit('"bbox":{'), direct, F.lit("}"))
    form = F.get(F.array(points, direct, as_list, as_dict), F.col("n") % 4)
    key = F.get(F.array(*[F.lit(k) for k in ("classTitle", "class", "label", "category")]), (F.col("k1") % 4).cast("int"))
    text = F.get(F.array(*[F.lit(t) for t in LABEL_TEXTS]), (F.col("k2") % 10).cast("int"))
    obj = F.concat(F.lit('{"'), key, F.lit('":"'), text, F.lit('",'), form, F.lit("}"))
    body = F.when(F.col("k1") % 3 == 0, F.concat(F.lit('{"objects":['), obj, F.lit("]}"))).when(
        F.col("k1") % 3 == 1, F.concat(F.lit('{"annotations":['), obj, F.lit("]}"))
    ).otherwise(F.concat(F.lit("["), obj, F.lit("]")))
    docs = base.select("split", "file", body.alias("text"))
    return base.select("split", "file", "width", "height"), docs


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, line_no, line``: one printed line per event, runs by user."""
    e = F.col("event_id")
    kind = F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit("Images processed: "), (e % 500 + 1).cast("string")))
        .when(kind == "click", F.concat(F.lit("Tiles generated: "), (e % 5000 + 1).cast("string")))
        .when(kind == "signup", F.concat(F.lit("Tiles kept by proposal model: "), (e % 3000).cast("string")))
        .when(kind == "purchase", F.concat(F.lit("Total time: "), (e % 90 + 10).cast("string"), F.lit(".5 sec")))
        .otherwise(F.concat(F.lit("Precision: 0."), F.lpad((e % 10000).cast("string"), 4, "0")))
    )
    run = F.concat(F.lit("run"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(run.alias("run"), e.alias("line_no"), line.alias("line"))
