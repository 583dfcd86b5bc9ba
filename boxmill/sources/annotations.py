"""Annotation JSON with a varying layout, converted to normalised boxes.

Documents: ``split, file, text``, where ``file`` is the image file name. Images: ``split, file, width, height``, with null sizes when
the image cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.functions.classes import class_of_label
from boxmill.functions.geometry import CORNERS, clamp01, corners, corners_to_center, is_valid, ordered_corners
from boxmill.functions.names import plain_path

# Where objects and labels are looked for, in this order.
OBJECT_KEYS = ("objects", "annotations", "boxes")
LABEL_KEYS = ("classTitle", "class", "label", "category")
DIRECT_KEYS = ("x_min", "y_min", "x_max", "y_max")


def read_annotations(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Documents below ``{root}/{split}/ann``; each is named like its image plus ``.json``. A missing split is skipped."""
    paths = [p for p in (f"{root}/{s}/ann" for s in splits) if _exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "split string, file string, text string")
    path = plain_path(F.col("_metadata.file_path"))
    return spark.read.option("pathGlobFilter", "*.json").text(paths, wholetext=True).select(
        F.regexp_extract(path, r"([^/]+)/ann/[^/]+$", 1).alias("split"),
        F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("file"),
        F.col("value").alias("text"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _member(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def _objects(root: Column, keys: Sequence[str]) -> Column:
    """Array of objects: the first key present decides, else the root itself if it is a list."""
    found = F.when(F.lit(False), F.lit(None).cast("array<variant>"))
    for key in keys:
        found = found.when(_member(root, key).isNotNull(), _member(root, key, "array<variant>"))
    return found.otherwise(F.try_variant_get(root, "$", "array<variant>"))


def object_label(obj: Column) -> Column:
    """Label text by the first label key present; a present null gives null."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for key in LABEL_KEYS:
        found = found.when(_member(obj, key).isNotNull(), _member(obj, key, "string"))
    return found


def object_box(obj: Column, with_bbox: bool = True) -> Column:
    """Corners as a struct: two points, else direct keys, else (``with_bbox``) a ``bbox`` list or object.

    Points that are not exactly two give null; the other forms are not tried then.
    """
    def box(values: Sequence[Column]) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, CORNERS)])

    points = _bound(_member(obj, "points.exterior", "array<array<double>>"), lambda p: box(ordered_corners(p)))
    direct = [_member(obj, k, "double") for k in DIRECT_KEYS]
    present = [_member(obj, k).isNotNull() for k in DIRECT_KEYS]
    result = F.when(_member(obj, "points.exterior").isNotNull(), points).when(
        present[0] & present[1] & present[2] & present[3], box(direct)
    )
    if with_bbox:
        four = lambda v: F.when(F.size(v) == 4, box([F.get(v, F.lit(i)) for i in range(4)]))
        as_dict = [_member(obj, f"bbox.{k}", "double") for k in DIRECT_KEYS]
        result = result.otherwise(
            F.coalesce(_bound(_member(obj, "bbox", "array<double>"), four), F.when(as_dict[0].isNotNull(), box(as_dict)))
        )
    return result


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside a function over an array, where nothing else is shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_documents(documents: DataFrame, full: bool = True) -> DataFrame:
    """``split, file, json, boxes``: every document parsed once, without its text.

    ``json`` is ok, bad_json, or odd_json: a text with a repeated key or a NaN, which looser readers take and this one
    does not. ``boxes`` holds the usable objects as ``obj_no, cls`` and pixel corners, which is all that later steps
    need, so only this moves in a join.
    """
    keys = OBJECT_KEYS if full else OBJECT_KEYS[:2]
    loose = {"allowNonNumericNumbers": "true"}
    odd = F.coalesce(
        F.size(F.from_json("text", "map<string,string>", loose)), F.size(F.from_json("text", "array<map<string,string>>", loose))
    ).isNotNull()
    read = documents.select("split", "file", "text", _evaluated_once(root=F.try_parse_json("text")))
    found = F.transform(
        _objects(F.col("root"), keys),
        lambda obj, n: F.struct(n.alias("obj_no"), object_label(obj).alias("label"), object_box(obj, full).alias("box")),
    )
    named = F.transform(found, lambda o: F.struct(o["obj_no"].alias("obj_no"), class_of_label(o["label"]).alias("cls"), o["box"].alias("box")))
    usable = F.filter(named, lambda o: o["cls"].isNotNull() & is_valid(corners(o["box"])))
    return read.select(
        "split", "file",
        F.when(F.col("root").isNotNull(), "ok").when(odd, "odd_json").otherwise("bad_json").alias("json"),
        usable.alias("boxes"),
    )


def _parsed(documents: DataFrame, full: bool) -> DataFrame:
    return documents if "json" in documents.columns else parse_documents(documents, full)


def document_status(images: DataFrame, documents: DataFrame) -> DataFrame:
    """Every image with ``status``: ok, no_annotation, unreadable, bad_json or odd_json.

    ``documents`` are texts or the result of ``parse_documents``.
    """
    joined = images.join(_parsed(documents, True).drop("boxes"), ["split", "file"], "left")
    status = F.when(F.col("json").isNull(), "no_annotation").when(F.col("width").isNull(), "unreadable").otherwise(F.col("json"))
    return joined.select(*images.columns, status.alias("status"))


def _evaluated_once(**columns: Column) -> Column:
    """Columns as a generated row: costly expressions run once, however often later steps and filters use them."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def convert_annotations(images: DataFrame, documents: DataFrame, full: bool = True) -> DataFrame:
    """Boxes of all usable documents: ``split, file, obj_no, cls, xc, yc, bw, bh`` with values in [0, 1].

    ``documents`` are texts or the result of ``parse_documents``. ``full`` reads all layouts (as for a test set);
    otherwise the ``boxes`` key and the ``bbox`` form are not known. Objects without a label, with an unknown label, without
    a box or with an empty box are dropped. So are documents of unreadable images and documents that are not JSON.
    """
    where = ["split", "file"]
    # A plain ``inline`` would infer a filter on the array, which is moved down and reads every document again.
    boxes = _parsed(documents, full).select(*where, F.inline_outer("boxes")).where(F.col("obj_no").isNotNull())
    sizes = images.filter(F.col("width").isNotNull()).select(*where, "width", "height")
    center = corners_to_center(corners(F.col("box")), F.col("width"), F.col("height"))
    return boxes.join(sizes, where).select(
        *where, "obj_no", "cls", *[clamp01(c).alias(n) for c, n in zip(center, ("xc", "yc", "bw", "bh"))]
    )


def conversion_counts(images: DataFrame, documents: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per split: processed and skipped images, by reason, and converted boxes."""
    status = F.col("status")
    per_split = document_status(images, documents).groupBy("split").agg(
        F.count_if(status == "ok").alias("processed"), F.count_if(status != "ok").alias("skipped"),
        *[F.count_if(status == s).alias(s) for s in ("no_annotation", "unreadable", "bad_json", "odd_json")],
    )
    totals = boxes.groupBy("split").agg(F.count(F.lit(1)).alias("boxes"))
    return per_split.join(totals, "split", "left").na.fill(0, ["boxes"])
