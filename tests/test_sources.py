import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxmill.functions import classes, names
from boxmill.sources import annotations, images, labels, tables


def write_png(path, bgr):
    h, w = bgr.shape[:2]
    raw = b"".join(b"\0" + bgr[y, :, ::-1].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (7, 12, 3), dtype=np.uint8)
    write_png(tmp_path / "val/images/b.png", pixels)
    write_png(tmp_path / "train/images/c.png", pixels)
    (tmp_path / "train/images/a.jpg").write_bytes(b"not an image")
    (tmp_path / "train/images/d.JPG").write_bytes(b"not an image")
    (tmp_path / "train/images/notes.txt").write_text("x")
    (tmp_path / "other/images").mkdir(parents=True)
    (tmp_path / "other/images/e.png").write_bytes(b"")
    listed = images.gather_images(spark, str(tmp_path)).orderBy("split_rank", "ext_rank", "path")
    assert [(r["split"], r["stem"]) for r in listed.collect()] == [("train", "a"), ("train", "c"), ("val", "b")]
    assert images.gather_images(spark, str(tmp_path), ignore_case=True).count() == 4

    kept = images.read_images(spark, str(tmp_path / "*/images/*.png"))
    assert [(r["height"], r["width"], bytes(r["data"])) for r in kept.filter("path like '%b.png'").collect()] == [(7, 12, pixels.tobytes())]
    everything = images.read_images(spark, str(tmp_path / "train/images"), drop_invalid=False)
    sizes = images.image_sizes(everything).filter("width is null")
    assert sizes.count() >= 1

    tiles = images.crop_tiles(kept.filter("path like '%b.png'"), tile=8, overlap=0.5).collect()
    assert [(t["tile_id"], t["x"], t["y"]) for t in tiles] == [(0, 0, 0), (1, 4, 0)]
    for t in tiles:
        got = np.frombuffer(t["data"], np.uint8).reshape(8, 8, 3)
        assert (got[:7] == pixels[:, t["x"] : t["x"] + 8]).all() and (got[7] == 114).all()


def test_many_tiles_leave_in_groups(spark):
    pixels = np.random.default_rng(3).integers(0, 256, (70, 90, 3), dtype=np.uint8)
    df = spark.createDataFrame([("p", 70, 90, 3, bytearray(pixels.tobytes()))], "path string, height int, width int, nChannels int, data binary")
    tiles = images.crop_tiles(df, tile=16, overlap=0.5).collect()
    assert len(tiles) > 3 * images.TILES_AT_ONCE and [t["tile_id"] for t in tiles] == list(range(len(tiles)))
    for t in tiles:
        part = pixels[t["y"] : t["y"] + 16, t["x"] : t["x"] + 16]
        assert (np.frombuffer(t["data"], np.uint8).reshape(16, 16, 3)[: part.shape[0], : part.shape[1]] == part).all()


def test_label_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.0 0.5 0.5 0.25 0.25\n\n2 0.1 0.1\n 3\t0 0 1 1 \r\nx 0 0 1 1\n")
    (tmp_path / "b.txt").write_text("")
    rows = labels.read_labels(spark, str(tmp_path)).orderBy("box_id").collect()
    assert [(r["stem"], r["box_id"], r["cls"], r["bw"]) for r in rows] == [("a", 0, 1, 0.25), ("a", 3, 3, 1.0)]
    with pytest.raises(Exception, match="not a label line"):
        labels.read_labels(spark, str(tmp_path), strict=True).collect()


def test_boxes_of_unlabelled_images(spark):
    sizes = spark.createDataFrame([("a", 100, 50), ("b", 10, 10)], "stem string, width int, height int")
    found = spark.createDataFrame([("a", 0, 1, 0.5, 0.5, 0.33, 0.5)], "stem string, box_id int, cls int, xc double, yc double, bw double, bh double")
    exact = {r["stem"]: r for r in labels.pixel_boxes(found, sizes, ["stem"]).collect()}
    assert [exact["a"][c] for c in ("x1", "y1", "x2", "y2")] == pytest.approx([33.5, 12.5, 66.5, 37.5])
    assert exact["b"]["x1"] is None
    whole = {r["stem"]: r for r in labels.pixel_boxes(found, sizes, ["stem"], integer=True).collect()}
    assert [whole["a"][c] for c in ("x1", "y1", "x2", "y2")] == [33, 12, 66, 37]


def test_label_writer(spark, tmp_path):
    rows = [("train", "a_tile0", 0, 1, 0.5, 0.25, 0.125, 1.0), ("train", "a_tile0", 1, 2, 0.1, 0.2, 0.3, 0.4), ("val", "7", 0, 0, 0.0, 0.0, 1.0, 1.0)]
    odd_names = ["000123", "1e5", "2020-01-01", "a b", "ä+%#"]
    rows += [("01", name, 0, 1, 0.5, 0.5, 0.1, 0.1) for name in odd_names]
    df = spark.createDataFrame(rows, "split string, stem string, box_id int, cls int, xc double, yc double, bw double, bh double")
    path = str(tmp_path / "labels")
    names = sorted({r[:2] for r in rows}) + [("val", "0456")]
    labels.write_labels(df, spark.createDataFrame(names, "split string, stem string"), path)
    assert sorted(map(tuple, labels.read_written_labels(spark, path).collect())) == sorted(rows)
    texts = {(r["split"], r["stem"]): r["text"] for r in labels.read_label_texts(spark, path).collect()}
    assert set(texts) == set(names) and texts["val", "0456"] == ""
    assert texts["train", "a_tile0"] == "1 0.500000 0.250000 0.125000 1.000000\n2 0.100000 0.200000 0.300000 0.400000"


def test_only_finite_decimal_numbers_are_read(spark):
    good = ["1 .5 0.5 1. 1e-1", "+1 0 0 0 -0"]
    bad = ["1 0.5d 0 0 0", "1f 0 0 0 0", "1 nan 0 0 0", "1 0 inf 0 0", "1 1e999 0 0 0", "1 0 0 0", "", " ", "1 0 0 0 0 0", "1 0x1 0 0 0"]
    lines = spark.createDataFrame([(line,) for line in good + bad], "line string")
    assert labels.parse_label_lines(lines).count() == 2
    assert labels.line_counts(lines).first().asDict() == dict(lines=12, boxes=2, blank=2, wrong_count=2, not_numbers=6)


def test_names_with_blanks_and_percent_signs(spark, tmp_path):
    """From files to labels and back: odd image names meet their annotations, a missing split is skipped."""
    odd_names = ["000123", "a b", "50%", "a+b", "x#1", "grün", "q%20r"]
    for name in odd_names:
        write_png(tmp_path / f"train/img/{name}.png", np.zeros((4, 8, 3), np.uint8))
        folder = tmp_path / "train/ann"
        folder.mkdir(parents=True, exist_ok=True)
        box = [] if name == "000123" else [{"label": "red", "bbox": [1, 1, 3, 3]}]
        (folder / f"{name}.png.json").write_text(json.dumps({"objects": box}))
    listed = images.gather_images(spark, str(tmp_path))
    assert sorted(r["stem"] for r in listed.collect()) == sorted(odd_names)
    sizes = listed.select("split", "file", "stem", F.lit(8).alias("width"), F.lit(4).alias("height"))
    documents = annotations.read_annotations(spark, str(tmp_path))
    boxes = annotations.convert_annotations(sizes, documents)
    counts = annotations.conversion_counts(sizes, documents, boxes).first()
    assert (counts["processed"], counts["skipped"], counts["boxes"]) == (len(odd_names), 0, len(odd_names) - 1)
    named = boxes.join(sizes.select("file", "stem"), "file").withColumnRenamed("obj_no", "box_id")
    labels.write_labels(named, sizes, str(tmp_path / "out"))
    texts = {r["stem"]: r["text"] for r in labels.read_label_texts(spark, str(tmp_path / "out")).collect()}
    assert texts == {n: "" if n == "000123" else "0 0.250000 0.500000 0.250000 0.500000" for n in odd_names}
    assert annotations.read_annotations(spark, str(tmp_path), ["nowhere"]).count() == 0
    for name in odd_names:
        (tmp_path / "txt").mkdir(exist_ok=True)
        (tmp_path / f"txt/{name}.txt").write_text("1 0 0 1 1")
    assert sorted(r["stem"] for r in labels.read_labels(spark, str(tmp_path / "txt")).collect()) == sorted(odd_names)


def test_odd_json_has_its_own_status(spark):
    texts = {"a": '{"a": 1, "a": 2}', "b": '{"objects": [], "x": NaN}', "c": "{broken", "d": "[]", "e": '[{"x": NaN}]'}
    pictures = spark.createDataFrame([("t", k, 9, 9) for k in texts], "split string, file string, width int, height int")
    documents = spark.createDataFrame([("t", k, v) for k, v in texts.items()], "split string, file string, text string")
    found = {r["file"]: r["status"] for r in annotations.document_status(pictures, documents).collect()}
    assert found == {"a": "odd_json", "b": "odd_json", "c": "bad_json", "d": "ok", "e": "odd_json"}


def test_logs_are_read_by_line(spark, tmp_path):
    (tmp_path / "run a%.log").write_bytes(b"one\rtwo\r\nthree\n\nfive")
    (tmp_path / "r2.v1.txt").write_text("x")
    rows = sorted(map(tuple, tables.read_run_logs(spark, str(tmp_path)).collect()))
    assert rows == [("r2.v1", 0, "x"), *(("run a%", k, v) for k, v in enumerate(["one", "two", "three", "", "five"]))]


OBJECTS = [
    ({"classTitle": "RedLeft", "points": {"exterior": [[9, 8], [1, 2]]}}, (0, 1, 2, 9, 8), True),
    ({"class": "yellow_blinking", "x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4.5}, (1, 1, 2, 3, 4.5), True),
    ({"label": "Green", "bbox": [1, 2, 3, 4]}, (2, 1, 2, 3, 4), False),
    ({"category": "switched OFF", "bbox": {"x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4}}, (3, 1, 2, 3, 4), False),
    # Three points: the direct keys are not tried.
    ({"label": "red", "points": {"exterior": [[1, 1], [2, 2], [3, 3]]}, "x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4}, None, True),
    # A present null label stops the search.
    ({"classTitle": None, "label": "red", "bbox": [1, 2, 3, 4]}, None, False),
    ({"label": "pedestrian", "bbox": [1, 2, 3, 4]}, None, False),
    ({"bbox": [1, 2, 3, 4]}, None, False),
    ({"label": "red", "bbox": [3, 2, 3, 4]}, None, False),
    ({"label": "red", "bbox": [1, 2, 3]}, None, False),
    ({"label": "red"}, None, False),
]


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("root", ["objects", "annotations", "boxes", None])
def test_annotation_forms(spark, full, root):
    objects = [o for o, _, _ in OBJECTS]
    text = json.dumps(objects if root is None else {"objects_": [], root: objects})
    pictures = spark.createDataFrame([("test", "a.png", 100, 10)], "split string, file string, width int, height int")
    documents = spark.createDataFrame([("test", "a.png", text)], "split string, file string, text string")
    found = annotations.convert_annotations(pictures, documents, full).orderBy("obj_no").collect()
    expected = {}
    for k, (_, box, short) in enumerate(OBJECTS):
        if box and (full or (short and root != "boxes")):
            cls, x1, y1, x2, y2 = box
            values = [(x1 + x2) / 200, (y1 + y2) / 20, (x2 - x1) / 100, (y2 - y1) / 10]
            expected[k] = [cls] + values
    assert {r["obj_no"]: [r["cls"], r["xc"], r["yc"], r["bw"], r["bh"]] for r in found} == {k: pytest.approx(v) for k, v in expected.items()}


def test_first_root_key_decides(spark):
    text = json.dumps({"annotations": [{"label": "red", "bbox": [1, 2, 3, 4]}], "objects": []})
    pictures = spark.createDataFrame([("test", "a", 9, 9)], "split string, file string, width int, height int")
    documents = spark.createDataFrame([("test", "a", text)], "split string, file string, text string")
    assert annotations.convert_annotations(pictures, documents).count() == 0


def test_conversion_counts(spark, tmp_path):
    for name, text in {"a.png": '{"objects": [{"label": "red", "bbox": [1, 2, 3, 4]}]}', "b.png": "{broken", "c.png": "{}"}.items():
        folder = tmp_path / "train/ann"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(text)
    rows = [("train", "a.png", 9, 9), ("train", "b.png", 9, 9), ("train", "c.png", None, None), ("train", "d.png", 9, 9), ("test", "e.png", 9, 9)]
    pictures = spark.createDataFrame(rows, "split string, file string, width int, height int")
    documents = annotations.read_annotations(spark, str(tmp_path), ["train"])
    boxes = annotations.convert_annotations(pictures, documents)
    found = {r["split"]: r for r in annotations.conversion_counts(pictures, documents, boxes).collect()}
    assert found["train"].asDict() == dict(split="train", processed=1, skipped=3, no_annotation=1, unreadable=1, bad_json=1, odd_json=0, boxes=1)
    assert (found["test"]["processed"], found["test"]["boxes"]) == (0, 0)
    shares = {r["name"]: (r["n"], r["percentage"]) for r in classes.class_distribution(boxes).collect()}
    assert shares == {"red": (1, 100.0), "yellow": (0, 0.0), "green": (0, 0.0), "off": (0, 0.0)}


def test_class_names(spark):
    df = spark.createDataFrame([(0,), (31,), (56,), (78,), (79,), (-1,)], "cls int")
    found = df.select(classes.class_name(F.col("cls")).alias("a"), classes.reduced_name(F.col("cls")).alias("b")).collect()
    assert [r["a"] for r in found] == ["tlr", "tln", "141", "tcbv", "79", "-1"]
    assert [r["b"] for r in found] == ["tlr", "132", "", "", "79", "-1"]
    reduced = classes.reduced_vocabulary(spark).orderBy("cls").collect()
    assert len(reduced) == 79 and (reduced[40]["old_cls"], reduced[40]["name"]) == (56, "141") and reduced[41]["name"] == ""


def test_names(spark):
    df = spark.createDataFrame([("/d/a_tile_b_tile12.jpg",), ("/d/plain.v2.png",), ("/d/x_tile3.JPEG",), ("/d/.hidden",)], "p string")
    got = df.select(names.stem(F.col("p")).alias("s"), names.base_of_tile_file(names.file_name(F.col("p"))).alias("f"))
    assert [tuple(r) for r in got.collect()] == [("a_tile_b_tile12", "a_tile_b"), ("plain.v2", None), ("x_tile3", "x"), (".hidden", None)]
    bases = got.select(names.base_of_tile(F.col("s")).alias("b")).collect()
    assert [r["b"] for r in bases] == ["a_tile_b", "plain.v2", "x", ".hidden"]


def test_detections_filter_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, 0.2), (1, 0.25), (1, 0.9)], "image_id long, conf double").write.parquet(path)
    df = tables.read_detections(spark, path)
    assert df.count() == 2
    df.explain("formatted")
    assert "GreaterThanOrEqual(conf,0.25)" in capsys.readouterr().out


def test_manifest_and_split_table(spark, tmp_path):
    pictures = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "c")], "split string, file string")
    tables.write_manifest(pictures, str(tmp_path / "m"))
    assert {r["split"]: r["n_images"] for r in spark.read.json(str(tmp_path / "m/splits")).collect()} == {"train": 2, "val": 1}
    assert spark.read.json(str(tmp_path / "m/classes")).count() == 4
    images.write_by_split(pictures, str(tmp_path / "t"))
    images.write_by_split(pictures.limit(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
