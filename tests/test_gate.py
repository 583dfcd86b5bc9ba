import numpy as np
import pytest
from pyspark.sql import functions as F

from boxmill.functions.pixels import FEATURES, blob_counts, components, edge_map, tile_features, to_gray, to_hsv
from boxmill.operators import diagnose, gating, runs
from boxmill.operators.features import extract_features, fit_gate, load_gate, save_gate, score_tiles
from boxmill.sources.tables import read_run_logs


def flood(mask):
    """Component areas and members by flood fill."""
    seen, groups = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, group = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            group.append((a, b))
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
        groups.append(sorted(group))
    return groups


def test_components_equal_flood_fill():
    rng = np.random.default_rng(0)
    masks = rng.random((6, 17, 23)) < np.array([0.1, 0.3, 0.4, 0.5, 0.7, 0.0])[:, None, None]
    # A spiral is one long component.
    masks[5, ::2] = True
    masks[5, 1::4, -1] = True
    masks[5, 3::4, 0] = True
    label = components(masks)
    counts = blob_counts(masks)
    for k, mask in enumerate(masks):
        groups = flood(mask)
        found = sorted(sorted(zip(*(i.tolist() for i in np.nonzero(label[k] == v)))) for v in np.unique(label[k][mask]))
        assert found == sorted(groups)
        areas = [len(g) for g in groups]
        assert counts[k].tolist() == [sum(2 <= a <= 20 for a in areas), sum(20 < a <= 80 for a in areas), max(areas, default=0)]


def test_components_of_real_tile_size():
    """Edge-rich pictures of 640 pixels: as quick as others, and equal to the flood fill in a corner of them."""
    rng = np.random.default_rng(5)
    mask = rng.random((2, 640, 640)) < np.array([0.42, 0.6])[:, None, None]
    label = components(mask)
    for k in range(2):
        groups = flood(mask[k])
        found = np.unique(label[k][mask[k]], return_counts=True)[1]
        assert sorted(found.tolist()) == sorted(len(g) for g in groups)
        smallest = {min(y * 640 + x for y, x in g) + k * 640 * 640 for g in groups}
        assert set(np.unique(label[k][mask[k]]).tolist()) == smallest


def test_edges_of_a_step_and_of_nothing():
    flat = np.full((1, 12, 12), 90)
    assert not edge_map(flat).any()
    step = flat.copy()
    step[0, :, 6:] = 200
    edges = edge_map(step)[0]
    assert edges.any(0).sum() == 1 and edges[:, 5:7].any(1).all()
    weak = flat.copy()
    weak[0, :, 6:] = 120  # Gradient 120: above the low, below the high threshold.
    assert not edge_map(weak).any()


def test_weak_edges_follow_strong_ones():
    tile = np.full((1, 20, 20), 50)
    tile[0, :10, 10:] = 200
    tile[0, 10:, 10:] = 80
    assert edge_map(tile)[0, 15:, 9:11].any()
    tile[0, :10, 10:] = 50
    assert not edge_map(tile)[0, 15:, 9:11].any()


def test_colours():
    pure = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [0, 255, 255], [255, 255, 255], [0, 0, 0]]], np.uint8)[None]
    h, s, v = to_hsv(pure)
    assert h[0, 0].tolist() == [0, 60, 120, 30, 0, 0]
    assert s[0, 0].tolist() == [255, 255, 255, 255, 0, 0]
    assert v[0, 0].tolist() == [255, 255, 255, 255, 255, 0]
    assert to_gray(pure)[0, 0].tolist() == [76, 150, 29, 226, 255, 0]


def test_feature_of_a_lamp():
    tile = np.full((40, 41, 3), 20, np.uint8)
    tile[4:8, 4:8] = (20, 20, 250)
    tile[30:34, 30:40] = 255
    row = dict(zip(FEATURES, tile_features(tile[None])[0]))
    assert row["max_red"] == 16 / 100 and row["top3_red"] == pytest.approx(16 / 300)
    assert row["max_green"] == 0 and row["medium_blobs"] == 1 and row["small_blobs"] == 0 and row["max_blob_area"] == 40
    assert row["bright_ratio"] == 40 / (40 * 41) and row["upper_bright_ratio"] == 0


def test_features_of_mixed_sizes(spark):
    rng = np.random.default_rng(1)
    tiles = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for h, w in [(8, 8), (9, 12), (8, 8), (9, 12)]]
    rows = [(k, t.shape[0], t.shape[1], bytearray(t.tobytes())) for k, t in enumerate(tiles)]
    df = spark.createDataFrame(rows, "tile_id int, height int, width int, data binary")
    found = {r["tile_id"]: [r[f] for f in FEATURES] for r in extract_features(df, ["tile_id"]).collect()}
    assert all(found[k] == pytest.approx(tile_features(t[None])[0].tolist()) for k, t in enumerate(tiles))


def logistic_by_newton(x, y):
    """Balanced, L2-regularised logistic regression on standardised features: 0.5 |w|^2 + summed weighted loss."""
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    design = np.hstack([x, np.ones((n, 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (weight * (p - y)) + penalty @ w
        w -= np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty, gradient)
    return 1 / (1 + np.exp(-design @ w))


def test_fitted_gate_equals_newton(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, len(FEATURES))) * rng.uniform(0.1, 20, len(FEATURES))
    y = (x[:, 0] / x[:, 0].std() + rng.normal(size=200) > 0.8).astype(int)
    rows = [(k, int(label), *map(float, values)) for k, (label, values) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "tile_id int, label int, " + ", ".join(f"{f} double" for f in FEATURES))
    model = fit_gate(df)
    expected = logistic_by_newton(x, y)
    save_gate(model, str(tmp_path / "gate"))
    for m in (model, load_gate(str(tmp_path / "gate"))):
        found = [r["prob"] for r in score_tiles(m, df).orderBy("tile_id").collect()]
        assert found == pytest.approx(expected.tolist(), abs=2e-3)
    with pytest.raises(ValueError):
        fit_gate(df.filter("label = 1"))


SCORES = "image_id long, tile_id int, prob double, label int"


def test_gate_reports(spark):
    scores = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.6, 1), (1, 2, 0.6, 0), (2, 0, 0.1, 0)], SCORES)
    total = gating.gate_totals(scores).first()
    assert (total["tiles"], total["kept_tiles"], total["images_with_kept"], total["tile_reduction"]) == (4, 2, 1, 0.5)
    sweep = {r["threshold"]: r for r in gating.threshold_sweep(scores, (0.5, 0.6)).collect()}
    assert (sweep[0.5]["kept_tiles"], sweep[0.5]["positive_recall"], sweep[0.6]["kept_tiles"]) == (2, 0.5, 0)
    assert [(r["image_id"], r["tile_id"]) for r in gating.top_tiles(scores).orderBy("image_id", "rank").collect()] == [(1, 1), (1, 2), (2, 0)]
    none = spark.createDataFrame([], SCORES)
    empty = gating.threshold_sweep(none, (0.5,)).first()
    assert (empty["tile_reduction"], empty["positive_recall"]) == (0.0, 0.0)
    assert gating.top_k_report(none).first()["positive_recall"] is None
    assert gating.gate_totals(none).first()["tile_reduction"] == 0.0


def test_blank_line_counts_as_object(spark):
    tiles = spark.createDataFrame([(1, 0), (1, 1)], "image_id long, tile_id int")
    lines = spark.createDataFrame([(1, 1, "")], "image_id long, tile_id int, line string")
    assert {r["tile_id"]: r["label"] for r in gating.tile_labels(tiles, lines).collect()} == {0: 0, 1: 1}


def test_leakage_guard(spark):
    train = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "image_id long, tile_id int")
    assert [tuple(r) for r in gating.without_test_images(train, train.filter("image_id = 1")).collect()] == [(2, 0)]


def test_quality_rules(spark):
    pictures = spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id long")
    box = "image_id long, {} int, cls int, x1 double, y1 double, x2 double, y2 double"
    # Image 1: one prediction serves two boxes. Image 2: no boxes. Image 3: no predictions. Image 4: wrong class.
    truth = spark.createDataFrame(
        [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 1.0, 0.0, 11.0, 10.0), (3, 0, 0, 0.0, 0.0, 9.0, 9.0), (4, 0, 2, 0.0, 0.0, 9.0, 9.0)],
        box.format("box_id"),
    )
    preds = spark.createDataFrame(
        [(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.8), (2, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.6), (4, 0, 1, 0.0, 0.0, 9.9, 9.9, 0.5)],
        box.format("det_id") + ", conf double",
    )
    q = {r["image_id"]: r for r in diagnose.image_quality(pictures, preds, truth).collect()}
    assert (q[1]["correct_matches"], q[1]["class_errors"], q[1]["missed_gt"], q[1]["false_positives"]) == (1, 1, 1, 0)
    assert (q[1]["recall"], q[1]["precision"]) == (0.5, 1.0) and q[1]["quality"] == pytest.approx(2 / 3 * 0.8)
    assert (q[2]["recall"], q[2]["precision"], q[2]["f1_score"], q[2]["false_positives"]) == (1.0, 0.0, 0.0, 1)
    assert (q[3]["recall"], q[3]["precision"], q[3]["avg_conf"], q[3]["missed_gt"]) == (0.0, 0.0, 0.0, 1)
    assert (q[4]["class_errors"], q[4]["quality"]) == (1, 0.0)
    e = {r["image_id"]: r["wrong"] for r in diagnose.image_errors(pictures, preds, truth).collect()}
    assert e == {1: True, 2: True, 3: True, 4: True}
    good = diagnose.image_errors(pictures, preds.filter("image_id = 4").withColumn("cls", F.lit(2)), truth.filter("image_id = 4"))
    assert good.filter("wrong").count() == 0


def test_run_logs(spark, tmp_path):
    (tmp_path / "one.log").write_text("hello\n  Images processed: 10\r\nTiles kept: 5\nTiles generated: 0\nPrecision: -0.5\nRecall: 0.25\nRecall: 0.75\n")
    (tmp_path / "two.log").write_text("Images processed: 4\nTiles kept by proposal model: 6\nTiles generated: 8\nTotal time: 2.5 sec\nREAL image-level FPS (with tiling): 3.20\n")
    (tmp_path / "three.log").write_text("nothing here\n")
    table = {r["run"]: r for r in runs.run_table(read_run_logs(spark, str(tmp_path))).collect()}
    one, two = table["one"], table["two"]
    assert (one["images_processed"], one["tiles_kept"], one["precision"], one["recall"]) == (10, 5, None, 0.75)
    assert (one["kept_per_image"], one["keep_rate"]) == (0.5, 0.0)
    assert (two["total_time"], two["real_fps"], two["keep_rate"], two["tiles_per_image"]) == (2.5, 3.2, 0.75, 2.0)
    assert table["three"]["images_processed"] is None
    delta = runs.kept_delta(runs.run_table(read_run_logs(spark, str(tmp_path))), "one", "two").first()
    assert delta["kept_difference"] == -1.0
