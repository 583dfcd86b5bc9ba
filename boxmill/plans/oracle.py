"""The catalog's queries in plain SQL (DuckDB), written from the definitions rather than from the Spark plans."""

from __future__ import annotations

import re

from boxmill.functions.classes import DETECTOR_CLASSES, KEPT_IDS

THRESHOLDS = "unnest([CAST(50 + 5 * k AS DOUBLE) / 100 FOR k IN range(10)])"


def iou_sql(a: str, b: str) -> str:
    w = f"greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    areas = " + ".join(f"greatest(0.0, {c}x2 - {c}x1) * greatest(0.0, {c}y2 - {c}y1)" for c in (a, b))
    return f"({w} * {h} / greatest({areas} - {w} * {h}, 1e-9))"


def _starts(length: str, tile: int, step: int) -> str:
    return (
        f"CASE WHEN {length} <= {tile} THEN [0] ELSE list_sort(list_distinct(list_concat("
        f"range(0, {length} - {tile} + 1, {step}), [CAST({length} - {tile} AS BIGINT)]))) END"
    )


def _nms(
    name: str, source: str, threshold: str, same_class: bool, limit: int | None, order: str = "conf DESC, det_id"
) -> str:
    """Walk through each image's detections in order, carrying the list of kept ones."""
    cls = "k.cls = o.cls AND " if same_class else ""
    full = f"len(w.kept) >= {limit} OR " if limit else ""
    hit = f"len(list_filter(w.kept, lambda k: {cls}{iou_sql('k.', 'o.')} > {threshold})) > 0"
    return f"""
{name}_ord AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rn,
         {{'det_id': det_id, 'cls': cls, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf}} AS det
  FROM {source}
),
{name}_walk AS (
  SELECT image_id, rn, [det] AS kept FROM {name}_ord WHERE rn = 1
  UNION ALL
  SELECT w.image_id, o.rn, CASE WHEN {full}{hit} THEN w.kept ELSE list_append(w.kept, o.det) END
  FROM {name}_walk w JOIN {name}_ord o ON o.image_id = w.image_id AND o.rn = w.rn + 1
),
{name} AS (
  SELECT image_id, unnest(kept, recursive := true)
  FROM (SELECT image_id, max_by(kept, rn) AS kept FROM {name}_walk GROUP BY image_id)
)"""


def _around(values: str, dy: int, dx: int, outside: str | None = None) -> str:
    """A neighbour of pixel (y, x) in a list of 8x8 values: the nearest one, or ``outside``, beyond the border."""
    if outside is None:
        return f"{values}[1 + 8 * least(7, greatest(0, y + {dy})) + least(7, greatest(0, x + {dx}))]"
    return f"CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN {values}[1 + 8 * (y + {dy}) + x + {dx}] ELSE {outside} END"


def _slope(down: bool) -> str:
    terms = []
    for k, weight in ((-1, 1), (0, 2), (1, 1)):
        a, b = ((1, k), (-1, k)) if down else ((k, 1), (k, -1))
        terms.append(f"{weight} * ({_around('gs', *a)} - {_around('gs', *b)})")
    return " + ".join(terms)


def _peak(first: tuple[int, int], second: tuple[int, int], strict: bool) -> str:
    return f"m > {_around('ms', *first, '0')} AND m {'>' if strict else '>='} {_around('ms', *second, '0')}"


COLOURS = (
    "max_red", "max_green", "max_yellow", "max_bright", "top3_red", "top3_green", "bright_ratio", "max_patch_brightness",
    "std_patch_brightness", "upper_bright_ratio",
)
FEATURES = (*COLOURS, "edge_density", "max_edge", "max_patch_edges", "small_blobs", "medium_blobs", "max_blob_area")
# The order of the model's coefficients.
MODEL = (
    "edge_density", "max_red", "max_green", "max_yellow", "max_bright", "max_edge", "top3_red", "top3_green", "bright_ratio", "small_blobs",
    "medium_blobs", "max_blob_area", "max_patch_brightness", "std_patch_brightness", "max_patch_edges", "upper_bright_ratio",
)


def _rounded(names: tuple[str, ...]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _scaled(feature: str) -> str:
    """A feature less its mean over its population deviation, 0 for a constant one."""
    return f"(({feature} - avg({feature}) OVER ()) / CASE WHEN stddev_pop({feature}) OVER () > 0 THEN stddev_pop({feature}) OVER () ELSE 1 END)"


CTES = {
    "images": """
images AS (
  SELECT o_orderkey AS image_id,
         CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split,
         CAST(480 + 160 * (o_orderkey % 9) AS INTEGER) AS width,
         CAST(400 + 120 * (o_custkey % 6) AS INTEGER) AS height
  FROM orders
)""",
    "gtk": """
gtk_rows AS (
  SELECT l_orderkey AS image_id, l_linenumber AS n, l_partkey AS k1, l_suppkey AS k2, CAST(l_quantity AS BIGINT) AS k3,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                                 l_extendedprice, l_shipdate) AS INTEGER) AS box_id
  FROM lineitem
),
gtk AS (
  SELECT *, x1 + 12 + (k1 * 7 + n * 13) % 61 AS x2, y1 + 20 + (k2 * 11 + n * 5 + k1) % 73 AS y2
  FROM (SELECT r.*, i.split, i.width, i.height, CAST(k1 % 4 AS INTEGER) AS cls,
               (k1 * 37 + k2 * 101 + n * 53) % (width - 100) AS x1, (k1 * 59 + k2 * 17 + n * 71) % (height - 100) AS y1
        FROM gtk_rows r JOIN images i USING (image_id))
)""",
    "gt": """
gt AS (
  SELECT image_id, split, width, height, box_id, cls, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
         CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2
  FROM gtk
)""",
    "det": """
det_near AS (
  SELECT image_id, box_id * 2 + dup AS det_id, CASE WHEN k3 % 9 = 0 THEN (cls + 1) % 4 ELSE cls END AS cls,
         x1 + (k2 * 3 + dup * 4) % 7 - 3 AS x1, y1 + (k1 * 5 + dup * 3) % 7 - 3 AS y1,
         x2 + (k1 * 3 + dup * 5) % 9 - 4 AS x2, y2 + (k3 * 3 + dup) % 9 - 4 AS y2,
         CAST((k1 * 131 + k2 * 197 + k3 * 89 + box_id * 41 + dup * 333) % 700 + 300 AS DOUBLE) / 1000 AS conf
  FROM gtk, (SELECT unnest([0, 1]) AS dup) WHERE k3 % 8 <> 0 AND (dup = 0 OR k1 % 3 = 0)
),
det_false AS (
  SELECT image_id, 1000 + box_id AS det_id, cls, x1 + 60 AS x1, y1 + 40 AS y1, x2 + 60 AS x2, y2 + 40 AS y2,
         CAST((k1 * 17 + k3 * 29) % 400 + 250 AS DOUBLE) / 1000 AS conf
  FROM gtk WHERE k3 % 6 = 0
),
det AS (
  SELECT image_id, CAST(det_id AS INTEGER) AS det_id, CAST(cls AS INTEGER) AS cls, CAST(x1 AS DOUBLE) AS x1,
         CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, conf
  FROM (SELECT * FROM det_near UNION ALL SELECT * FROM det_false)
)""",
    "tiles": f"""
tile_rows AS (
  SELECT image_id, split, width, height, unnest(ys) AS y1, unnest(range(len(ys))) AS "row", xs
  FROM (SELECT *, {_starts('height', 640, 512)} AS ys, {_starts('width', 640, 512)} AS xs FROM images)
),
tiles AS (
  SELECT image_id, split, CAST("row" AS INTEGER) AS "row", CAST(unnest(range(len(xs))) AS INTEGER) AS col,
         CAST(len(xs) AS INTEGER) AS n_cols, CAST(unnest(xs) AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1
  FROM tile_rows
),
tile_grid AS (
  SELECT image_id, split, "row", col, "row" * n_cols + col AS tile_id, x1, y1, x1 + 640 AS x2, y1 + 640 AS y2 FROM tiles
)""",
    "cuts": """
cuts AS (
  SELECT b.image_id, t.tile_id, b.box_id, b.cls, t.x1 AS tx, t.y1 AS ty,
         greatest(b.x1, t.x1) AS ix1, greatest(b.y1, t.y1) AS iy1, least(b.x2, t.x2) AS ix2, least(b.y2, t.y2) AS iy2,
         (b.x2 - b.x1) * (b.y2 - b.y1) AS whole
  FROM gt b JOIN tile_grid t ON b.image_id = t.image_id
       AND b.x1 < t.x2 AND t.x1 < b.x2 AND b.y1 < t.y2 AND t.y1 < b.y2
)""",
    "tile_boxes": """
tile_boxes AS (
  SELECT image_id, tile_id, box_id, cls,
         greatest(0.0, least(1.0, ((ix1 + ix2) / 2 - tx) / 640)) AS xc,
         greatest(0.0, least(1.0, ((iy1 + iy2) / 2 - ty) / 640)) AS yc,
         greatest(0.0, least(1.0, (ix2 - ix1) / 640)) AS bw, greatest(0.0, least(1.0, (iy2 - iy1) / 640)) AS bh
  FROM cuts WHERE (ix2 - ix1) * (iy2 - iy1) / whole >= 0.3
)""",
    "tile_scores": """
tile_scores AS (
  SELECT t.image_id, t.tile_id, CAST((t.image_id * 37 + t.tile_id * 211) % 600 + 350 * label AS DOUBLE) / 1000 AS prob, label
  FROM (SELECT g.image_id, g.tile_id, CASE WHEN b.tile_id IS NULL THEN 0 ELSE 1 END AS label
        FROM tile_grid g LEFT JOIN (SELECT DISTINCT image_id, tile_id FROM tile_boxes) b USING (image_id, tile_id)) t
)""",
    "sizes": """
sizes AS (
  SELECT image_id, quantile_cont((x2 - x1) * (y2 - y1) / (width * height), 0.1) AS share,
         CAST(trunc((sum(x2 - x1) + sum(y2 - y1)) / (2 * count(*)) * 1.5) AS INTEGER) AS overlap_px
  FROM gt GROUP BY image_id
)""",
    "plan": """
plan_n AS (
  SELECT i.*, share, coalesce(overlap_px, 128) AS overlap_px,
         CASE WHEN share IS NULL OR share <= 0 THEN 1
              ELSE CAST(greatest(1, least(6, ceil(sqrt(0.04 / share)))) AS INTEGER) END AS n_tiles
  FROM images i LEFT JOIN sizes USING (image_id)
),
plan AS (
  SELECT *, CASE WHEN n_tiles = 1 THEN width ELSE 640 END AS tile_w, CASE WHEN n_tiles = 1 THEN height ELSE 640 END AS tile_h,
         CASE WHEN n_tiles = 1 THEN width ELSE greatest(1, 640 - overlap_px) END AS step_x,
         CASE WHEN n_tiles = 1 THEN height ELSE greatest(1, 640 - overlap_px) END AS step_y
  FROM plan_n
)""",
    "adaptive": """
adaptive_rows AS (
  SELECT *, unnest(range(0, greatest(1, height - tile_h + 1), step_y)) AS sy,
         range(0, greatest(1, width - tile_w + 1), step_x) AS sxs
  FROM plan
),
adaptive_cols AS (SELECT *, unnest(sxs) AS sx FROM adaptive_rows),
adaptive AS (
  SELECT image_id, CAST(sy // step_y AS INTEGER) AS "row", CAST(sx // step_x AS INTEGER) AS col,
         CAST(sy // step_y * len(sxs) + sx // step_x AS INTEGER) AS tile_id, tile_w, tile_h,
         CAST(least(width, sx + tile_w) - tile_w AS INTEGER) AS x1, CAST(least(height, sy + tile_h) - tile_h AS INTEGER) AS y1,
         CAST(least(width, sx + tile_w) AS INTEGER) AS x2, CAST(least(height, sy + tile_h) AS INTEGER) AS y2
  FROM adaptive_cols
)""",
    "merged": _nms("merged", "det", "0.5", True, 300),
    "merged45": _nms("merged45", "det", "0.45", True, 300),
    "odd_det": """
odd_det AS (
  SELECT * REPLACE (CASE WHEN image_id % 97 = 0 THEN NULL WHEN image_id % 89 = 0 THEN CAST('nan' AS DOUBLE) ELSE conf END AS conf)
  FROM det
)""",
    "odd": _nms(
        "odd", "odd_det", "0.5", True, None,
        "CASE WHEN conf IS NULL THEN 2 WHEN isnan(conf) THEN 1 ELSE 0 END, CASE WHEN conf IS NULL OR isnan(conf) THEN 0 ELSE -conf END, det_id",
    ),
    "agnostic": _nms("agnostic", "det", "0.5", False, 300),
    "det_int": """
det_int AS (
  SELECT image_id, det_id, cls, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1,
         CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2, conf
  FROM det
)""",
    "reported": _nms("reported", "det_int", "0.5", False, None),
    "pairs": f"""
pairs AS (
  SELECT p.image_id, p.det_id, p.cls, p.conf, g.box_id, g.cls AS truth_cls, {iou_sql('p.', 'g.')} AS iou
  FROM merged p JOIN gt g ON p.image_id = g.image_id AND p.cls = g.cls
  WHERE {iou_sql('p.', 'g.')} >= 0.5
)""",
    "best": """
best AS (
  SELECT p.image_id, p.det_id, p.cls, p.conf, b.iou AS best_iou, b.box_id AS best_box
  FROM merged p LEFT JOIN (
    SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, box_id) = 1
  ) b USING (image_id, det_id)
)""",
    "tp": f"""
at_thr AS (SELECT b.*, t.iou_thr FROM best b, (SELECT {THRESHOLDS} AS iou_thr) t),
tp AS (
  SELECT image_id, det_id, cls, conf, best_box, iou_thr,
         CASE WHEN best_iou >= iou_thr AND row_number() OVER (
           PARTITION BY image_id, cls, best_box, iou_thr, coalesce(best_iou >= iou_thr, false)
           ORDER BY conf DESC, det_id) = 1 THEN 1 ELSE 0 END AS hit
  FROM at_thr
)""",
    "counts": "counts AS (SELECT cls, count(*) AS n_gt FROM gt GROUP BY cls)",
    "curve": """
cumulated AS (
  SELECT cls, iou_thr, hit, conf, image_id, det_id,
         row_number() OVER w AS rank, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS tp_cum
  FROM tp WINDOW w AS (PARTITION BY cls, iou_thr ORDER BY conf DESC, image_id, det_id)
),
curve_all AS (
  SELECT *, max(precision) OVER (PARTITION BY cls, iou_thr ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS envelope
  FROM (SELECT *, tp_cum / (rank + 1e-9) AS precision FROM cumulated)
),
curve AS (SELECT * FROM curve_all WHERE hit = 1)""",
    "ap": f"""
ap AS (
  SELECT c.cls, t.iou_thr, c.n_gt, coalesce(sum(v.envelope) / (c.n_gt + 1e-9), 0.0) AS ap
  FROM counts c CROSS JOIN (SELECT {THRESHOLDS} AS iou_thr) t
  LEFT JOIN curve v ON v.cls = c.cls AND v.iou_thr = t.iou_thr
  GROUP BY c.cls, t.iou_thr, c.n_gt
)""",
    "micro": """
micro AS (
  SELECT tp, fp, fn, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall
  FROM (SELECT sum(coalesce(m.tp, 0)) AS tp, sum(coalesce(m.n, 0) - coalesce(m.tp, 0)) AS fp,
               sum(n_gt - coalesce(m.tp, 0)) AS fn
        FROM counts c LEFT JOIN (
          SELECT cls, sum(hit) AS tp, count(*) AS n FROM tp WHERE iou_thr = 0.5 GROUP BY cls) m USING (cls))
)""",
    "quality": f"""
qpairs AS (
  SELECT p.image_id, p.det_id, p.cls AS pred_cls, p.conf, g.box_id, g.cls AS truth_cls
  FROM (SELECT image_id, det_id, cls, conf, trunc(x1) AS x1, trunc(y1) AS y1, trunc(x2) AS x2, trunc(y2) AS y2 FROM merged45) p
  JOIN (SELECT image_id, box_id, cls, trunc(x1) AS x1, trunc(y1) AS y1, trunc(x2) AS x2, trunc(y2) AS y2 FROM gt) g USING (image_id)
  WHERE {iou_sql('p.', 'g.')} >= 0.5
),
qfirst AS (
  SELECT * FROM qpairs QUALIFY row_number() OVER (PARTITION BY image_id, box_id ORDER BY conf DESC, det_id) = 1
),
quality0 AS (
  SELECT i.image_id, coalesce(g.n, 0) AS total_gt, coalesce(p.n, 0) AS n_pred, coalesce(p.c, 0.0) AS avg_conf,
         coalesce(f.ok, 0) AS correct_matches, coalesce(f.bad, 0) AS class_errors, coalesce(f.used, 0) AS n_used
  FROM images i
  LEFT JOIN (SELECT image_id, count(*) AS n FROM gt GROUP BY 1) g USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS n, avg(conf) AS c FROM merged45 GROUP BY 1) p USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) FILTER (pred_cls = truth_cls) AS ok, count(*) FILTER (pred_cls <> truth_cls) AS bad,
                    count(DISTINCT det_id) AS used FROM qfirst GROUP BY 1) f USING (image_id)
),
quality1 AS (
  SELECT *, CASE WHEN total_gt > 0 THEN correct_matches / total_gt ELSE 1.0 END AS recall,
         CASE WHEN n_pred > 0 THEN correct_matches / n_pred ELSE 0.0 END AS precision
  FROM quality0
),
quality AS (
  SELECT image_id, total_gt, n_pred, correct_matches, class_errors, n_pred - n_used AS false_positives,
         total_gt - n_used AS missed_gt, recall, precision, f1_score, avg_conf, f1_score * avg_conf AS quality
  FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0.0 END AS f1_score
        FROM quality1)
)""",
    "errors": f"""
epairs AS (
  SELECT p.image_id, p.det_id, p.cls AS pred_cls, g.box_id, g.cls AS truth_cls
  FROM reported p JOIN gt g USING (image_id) WHERE {iou_sql('p.', 'g.')} >= 0.5
),
errors AS (
  SELECT i.image_id, coalesce(g.n, 0) - coalesce(e.boxes, 0) AS missed_gt, coalesce(e.conflicts, 0) AS class_conflicts,
         coalesce(p.n, 0) - coalesce(e.dets, 0) AS unused_preds
  FROM images i
  LEFT JOIN (SELECT image_id, count(*) AS n FROM gt GROUP BY 1) g USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS n FROM reported GROUP BY 1) p USING (image_id)
  LEFT JOIN (SELECT image_id, count(DISTINCT box_id) AS boxes, count(DISTINCT det_id) AS dets,
                    count(*) FILTER (pred_cls <> truth_cls) AS conflicts FROM epairs GROUP BY 1) e USING (image_id)
)""",
    "logs": """
logs AS (
  SELECT 'run' || user_id AS run, event_id AS line_no,
         CASE event_type WHEN 'view' THEN 'images_processed' WHEN 'click' THEN 'tiles_generated'
              WHEN 'signup' THEN 'tiles_kept' WHEN 'purchase' THEN 'total_time' ELSE 'precision' END AS metric,
         CASE event_type WHEN 'view' THEN event_id % 500 + 1 WHEN 'click' THEN event_id % 5000 + 1
              WHEN 'signup' THEN event_id % 3000 WHEN 'purchase' THEN event_id % 90 + 10 + 0.5
              ELSE CAST(event_id % 10000 AS DOUBLE) / 10000 END AS value
  FROM events
),
log_last AS (SELECT run, metric, CAST(max_by(value, line_no) AS DOUBLE) AS value FROM logs GROUP BY run, metric)""",
    "run_wide": """
run_wide AS (
  SELECT run, CAST(max(value) FILTER (metric = 'images_processed') AS BIGINT) AS images_processed,
         CAST(max(value) FILTER (metric = 'tiles_generated') AS BIGINT) AS tiles_generated,
         CAST(max(value) FILTER (metric = 'tiles_kept') AS BIGINT) AS tiles_kept,
         max(value) FILTER (metric = 'total_time') AS total_time, max(value) FILTER (metric = 'precision') AS precision
  FROM log_last GROUP BY run
)""",
    "times": """
times AS (
  SELECT 'run' || user_id AS run, ['io', 'tiling', 'proposal', 'detector', 'nms', 'truth'][event_id % 6 + 1] AS stage,
         CAST(event_id % 40 AS DOUBLE) / 4 AS seconds
  FROM events
),
totals AS (SELECT run, sum(seconds) * 1.25 AS total_time, count(*) AS n FROM times GROUP BY run)""",
    "docs": """
docs AS (
  SELECT *, image_id || '_' || box_id AS file,
         CASE k2 % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 2
              WHEN 7 THEN 3 WHEN 9 THEN 0 END AS label_cls
  FROM gtk
),
conv AS (
  SELECT split, file, image_id, box_id, n, 0 AS obj_no, label_cls AS cls,
         greatest(0.0, least(1.0, (x1 + x2) / 2.0 / width)) AS xc, greatest(0.0, least(1.0, (y1 + y2) / 2.0 / height)) AS yc,
         greatest(0.0, least(1.0, (x2 - x1) / width)) AS bw, greatest(0.0, least(1.0, (y2 - y1) / height)) AS bh
  FROM docs WHERE label_cls IS NOT NULL
)""",
    "px": """
px_v AS (
  SELECT vec_id, list_transform(embedding, lambda e:
           CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) * 2 + 0.5) * 255))) AS BIGINT)) AS v
  FROM embeddings
),
px0 AS (SELECT vec_id, v, unnest(range(64)) AS i FROM px_v),
px AS (
  SELECT vec_id, vec_id // 4 AS image_id, CAST(vec_id % 4 AS INTEGER) AS tile_id, i // 8 AS y, i % 8 AS x,
         v[i + 1] AS b, v[(i + 21) % 64 + 1] AS g, v[(i + 42) % 64 + 1] AS r
  FROM px0
)""",
    "px_masks": f"""
px_gray AS (
  SELECT *, (b * 3735 + g * 19235 + r * 9798 + 16384) >> 15 AS gray, greatest(b, g, r) AS mx,
         greatest(b, g, r) - least(b, g, r) AS diff
  FROM px
),
px_hue AS (
  SELECT *, CASE WHEN mx > 0 THEN (diff * CAST(round(1044480.0 / mx) AS BIGINT) + 2048) // 4096 ELSE 0 END AS s,
         CASE WHEN diff = 0 THEN 0 ELSE CAST(floor((
           (CASE WHEN mx = r THEN g - b WHEN mx = g THEN b - r + 2 * diff ELSE r - g + 4 * diff END)
           * CAST(round(122880.0 / diff) AS BIGINT) + 2048) / 4096.0) AS BIGINT) END AS h0
  FROM px_gray
),
px_masks AS (
  SELECT *, CAST((h BETWEEN 0 AND 10 OR h BETWEEN 170 AND 180) AND s >= 100 AND mx >= 100 AS INTEGER) AS red,
         CAST(h BETWEEN 35 AND 90 AND s >= 80 AND mx >= 80 AS INTEGER) AS green,
         CAST(h BETWEEN 15 AND 35 AND s >= 80 AND mx >= 80 AS INTEGER) AS yellow, CAST(gray > 220 AS INTEGER) AS bright
  FROM (SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h FROM px_hue)
),
px_grays AS (SELECT vec_id, list(gray ORDER BY y, x) AS gs FROM px_gray GROUP BY vec_id),
px_slopes AS (
  SELECT vec_id, image_id, tile_id, y, x, {_slope(False)} AS gx, {_slope(True)} AS gy FROM px JOIN px_grays USING (vec_id)
),
px_strengths AS (SELECT vec_id, list(abs(gx) + abs(gy) ORDER BY y, x) AS ms FROM px_slopes GROUP BY vec_id),
px_edges0 AS (
  SELECT *, abs(gx) + abs(gy) AS m FROM px_slopes JOIN px_strengths USING (vec_id)
),
px_edges AS (
  SELECT vec_id, image_id, tile_id, y, x, m > 200 AS strong FROM px_edges0
  WHERE m > 100 AND CASE WHEN abs(gy) < abs(gx) * tan(pi() / 8) THEN {_peak((0, -1), (0, 1), False)}
                         WHEN abs(gy) > abs(gx) * tan(3 * pi() / 8) THEN {_peak((-1, 0), (1, 0), False)}
                         WHEN (gx < 0) <> (gy < 0) THEN {_peak((-1, 1), (1, -1), True)}
                         ELSE {_peak((-1, -1), (1, 1), True)} END
),
px_reached AS (
  SELECT vec_id, y, x FROM px_edges WHERE strong
  UNION
  SELECT e.vec_id, e.y, e.x FROM px_reached r JOIN px_edges e ON e.vec_id = r.vec_id AND abs(e.y - r.y) <= 1 AND abs(e.x - r.x) <= 1
),
px_spread AS (
  SELECT vec_id, y, x, 8 * y + x AS root FROM px_masks WHERE bright = 1
  UNION
  SELECT b.vec_id, b.y, b.x, s.root FROM px_spread s JOIN px_masks b
    ON b.bright = 1 AND b.vec_id = s.vec_id AND abs(b.y - s.y) <= 1 AND abs(b.x - s.x) <= 1
),
px_blobs AS (
  SELECT vec_id, count(*) FILTER (area BETWEEN 2 AND 20) AS small, count(*) FILTER (area BETWEEN 21 AND 80) AS medium, max(area) AS largest
  FROM (SELECT vec_id, root, count(*) AS area FROM (SELECT vec_id, y, x, min(root) AS root FROM px_spread GROUP BY 1, 2, 3) GROUP BY 1, 2)
  GROUP BY vec_id
),
px_edge_patches AS (
  SELECT p.vec_id, p.y // 2 AS py, p.x // 2 AS px, avg(CAST(r.vec_id IS NOT NULL AS INTEGER)) AS edges
  FROM px p LEFT JOIN px_reached r ON r.vec_id = p.vec_id AND r.y = p.y AND r.x = p.x GROUP BY 1, 2, 3
),
shapes AS (
  SELECT vec_id // 4 AS image_id, CAST(vec_id % 4 AS INTEGER) AS tile_id, avg(edges) AS density, max(edges) AS max_edge,
         any_value(coalesce(small, 0)) AS small, any_value(coalesce(medium, 0)) AS medium, any_value(coalesce(largest, 0)) AS largest
  FROM px_edge_patches LEFT JOIN px_blobs USING (vec_id) GROUP BY vec_id
),
patches AS (
  SELECT image_id, tile_id, avg(red) AS red, avg(green) AS green, avg(yellow) AS yellow, avg(bright) AS bright, avg(gray) AS gray
  FROM px_masks GROUP BY image_id, tile_id, y // 2, x // 2
)""",
    "feats": """
feats AS (
SELECT c.*, CAST(e.label < 3 AS INTEGER) AS label, density AS edge_density, max_edge AS max_edge,
  max_edge AS max_patch_edges, CAST(small AS DOUBLE) AS small_blobs, CAST(medium AS DOUBLE) AS medium_blobs,
  CAST(largest AS DOUBLE) AS max_blob_area
FROM colours c JOIN shapes USING (image_id, tile_id) JOIN embeddings e ON e.vec_id = c.image_id * 4 + c.tile_id
)""",
    "colours": """
colours AS (
SELECT image_id, tile_id, max(red) AS max_red, max(green) AS max_green, max(yellow) AS max_yellow,
  max(bright) AS max_bright, list_avg(list_reverse_sort(list(red))[1:3]) AS top3_red,
  list_avg(list_reverse_sort(list(green))[1:3]) AS top3_green, any_value(ratio) AS bright_ratio,
  max(gray) AS max_patch_brightness, stddev_pop(gray) AS std_patch_brightness, any_value(upper) AS upper_bright_ratio
FROM patches JOIN (SELECT image_id, tile_id, avg(bright) AS ratio, avg(bright) FILTER (y < 4) AS upper FROM px_masks GROUP BY 1, 2)
  USING (image_id, tile_id) GROUP BY image_id, tile_id
)""",
}

DEPENDS = {
    "gtk": ["images"], "gt": ["gtk"], "det": ["gtk"], "tiles": ["images"], "cuts": ["gt", "tiles"], "tile_boxes": ["cuts"],
    "tile_scores": ["tile_boxes"], "sizes": ["gt"], "plan": ["sizes"], "adaptive": ["plan"], "merged": ["det"],
    "merged45": ["det"], "odd_det": ["det"], "odd": ["odd_det"], "agnostic": ["det"], "det_int": ["det"], "reported": ["det_int"], "pairs": ["merged", "gt"],
    "best": ["pairs"], "tp": ["best"], "counts": ["gt"], "curve": ["tp"], "ap": ["curve", "counts"], "micro": ["tp", "counts"],
    "quality": ["merged45", "gt"], "errors": ["reported", "gt"], "run_wide": ["logs"], "docs": ["gtk"], "px_masks": ["px"], "colours": ["px_masks"], "feats": ["colours"],
}


def build(body: str, *needs: str) -> str:
    """A full statement: the body after the common table expressions it needs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for d in DEPENDS.get(name, []):
            add(d)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        add(name)
    if not wanted:
        return body
    return "WITH RECURSIVE " + ",\n".join(CTES[n].strip() for n in wanted) + "\n" + body


LINE_BOX = "CAST(x1 AS DOUBLE) / 10000 AS xc, CAST(y1 AS DOUBLE) / 10000 AS yc, CAST(x2 AS DOUBLE) / 10000 AS bw, CAST(y2 AS DOUBLE) / 10000 AS bh"

LISTING = """
listing AS (
  SELECT '/data/' || split || '/images/' || file AS path, split, file, regexp_replace(file, '\\.[^.]*$', '') AS stem, ext
  FROM (SELECT split, ext, 'img.v1_' || image_id || '.' || ext AS file
        FROM (SELECT *, ['jpg', 'jpeg', 'png', 'JPG', 'bmp'][image_id % 5 + 1] AS ext FROM images))
)
SELECT path, split, file, stem, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS split_rank,
       CASE {ext} WHEN 'jpg' THEN 1 WHEN 'jpeg' THEN 2 ELSE 3 END AS ext_rank
FROM listing WHERE {ext} IN ('jpg', 'jpeg', 'png')"""


def _listing(ext: str) -> str:
    return build("SELECT 1", "images").replace("\nSELECT 1", ",") + LISTING.replace("{ext}", ext)


def _crops(tile: int, starts: list[int]) -> str:
    spots = ", ".join(
        f"({j * len(starts) + i}, {x}, {y})" for j, y in enumerate(starts) for i, x in enumerate(starts)
    )
    cell = "coalesce(printf('%02X%02X%02X', p.b, p.g, p.r), '727272')"
    return build(
        f"""SELECT q.image_id || '_' || q.tile_id AS path, s.tile_id, s.x, s.y,
  string_agg({cell}, '' ORDER BY k.dy, k.dx) AS pixels
FROM (SELECT DISTINCT vec_id, image_id, tile_id FROM px) q
CROSS JOIN (VALUES {spots}) s(tile_id, x, y)
CROSS JOIN (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range({tile})) AS d) a, (SELECT unnest(range({tile})) AS d) b) k
LEFT JOIN px p ON p.vec_id = q.vec_id AND p.y = s.y + k.dy AND p.x = s.x + k.dx
GROUP BY ALL""",
        "px",
    )


def _names(expr: str, names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"CASE WHEN {expr} < {len(names)} THEN [{listed}][{expr} + 1] ELSE CAST({expr} AS VARCHAR) END"


REDUCED = [DETECTOR_CLASSES[i] for i in KEPT_IDS] + [""] * (len(DETECTOR_CLASSES) - len(KEPT_IDS))

R9 = "round(xc, 9) AS xc, round(yc, 9) AS yc, round(bw, 9) AS bw, round(bh, 9) AS bh"

STRATUM_KEY = "md5('42:' || image_id || '_tile' || tile_id)"

ORACLE: dict[str, str] = {
    "image_listing": _listing("ext"),
    "image_listing_any_case": _listing("lower(ext)"),
    "image_sizes": build(
        """SELECT CAST(image_id AS VARCHAR) AS path, CASE WHEN image_id % 50 <> 0 THEN width END AS width,
  CASE WHEN image_id % 50 <> 0 THEN height END AS height FROM images""", "images"),
    "labels_tolerant": build(f"SELECT image_id, box_id, cls, {LINE_BOX} FROM gt WHERE box_id % 7 <> 0 AND box_id % 5 <> 0", "gt"),
    "labels_strict": build(f"SELECT image_id, box_id, cls, {LINE_BOX} FROM gt", "gt"),
    "detections_above_floor": build("SELECT * FROM det WHERE conf >= 0.5", "det"),
    "run_log_metrics": build("SELECT run, metric, round(value, 6) AS value FROM log_last", "logs"),
    "dataset_manifest": build("SELECT split, 'images/' || split AS path, count(*) AS n_images, 4 AS n_classes FROM images GROUP BY split", "images"),
    "tile_crops": _crops(5, [0, 3]),
    "tile_crops_padded": _crops(10, [0]),
    "annotations_converted": build(f"SELECT split, file, obj_no, cls, {R9} FROM conv", "docs"),
    "annotations_converted_short": build(f"SELECT split, file, obj_no, cls, {R9} FROM conv WHERE n % 4 IN (0, 1)", "docs"),
    "annotation_counts": build(
        """SELECT split, count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status <> 'ok') AS skipped,
  count(*) FILTER (status = 'none') AS no_annotation, count(*) FILTER (status = 'unreadable') AS unreadable,
  count(*) FILTER (status = 'bad') AS bad_json, count(*) FILTER (status = 'odd') AS odd_json,
  count(*) FILTER (status = 'ok' AND label_cls IS NOT NULL) AS boxes
FROM (SELECT *, CASE WHEN box_id % 5 = 0 THEN 'none' WHEN box_id % 3 = 0 THEN 'unreadable' WHEN box_id % 7 = 0 THEN 'bad'
                     WHEN box_id % 11 < 2 THEN 'odd' ELSE 'ok' END AS status FROM docs)
GROUP BY split""", "docs"),
    "label_text": build(
        """SELECT i.split, lpad(CAST(i.image_id AS VARCHAR), 12, '0') AS stem,
  CAST(row_number() OVER (PARTITION BY i.image_id ORDER BY box_id) - 1 AS INTEGER) + CASE WHEN box_id IS NULL THEN NULL ELSE 0 END AS box_id, cls,
  CAST(x1 + x2 AS BIGINT) AS xc, CAST(y1 + y2 AS BIGINT) AS yc, CAST(2 * (x2 - x1) AS BIGINT) AS bw, CAST(2 * (y2 - y1) AS BIGINT) AS bh
FROM images i LEFT JOIN gt USING (image_id)""", "gt"),
    "label_files": build(
        """SELECT i.split, lpad(CAST(i.image_id AS VARCHAR), 12, '0') AS stem,
  CAST(row_number() OVER (PARTITION BY i.image_id ORDER BY box_id) - 1 AS INTEGER) + CASE WHEN box_id IS NULL THEN NULL ELSE 0 END AS box_id, cls,
  CAST(x1 + x2 AS BIGINT) AS xc, CAST(y1 + y2 AS BIGINT) AS yc, CAST(2 * (x2 - x1) AS BIGINT) AS bw, CAST(2 * (y2 - y1) AS BIGINT) AS bh
FROM images i LEFT JOIN (SELECT * FROM gt WHERE image_id % 7 <> 0) USING (image_id)""", "gt"),
    "class_distribution": build(
        """SELECT s.split, c.cls, ['red', 'yellow', 'green', 'off'][c.cls + 1] AS name, count(v.cls) AS n,
  round(count(v.cls) / s.total * 100, 6) AS percentage
FROM (SELECT split, count(*) AS total FROM conv GROUP BY split) s CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS cls) c
LEFT JOIN conv v ON v.split = s.split AND v.cls = c.cls GROUP BY s.split, s.total, c.cls""", "docs"),
    "boxes_normalised": build(
        """SELECT image_id, box_id, cls, round((x1 + x2) / 2 / width, 9) AS xc, round((y1 + y2) / 2 / height, 9) AS yc,
  round((x2 - x1) / width, 9) AS bw, round((y2 - y1) / height, 9) AS bh FROM gt""", "gt"),
    "boxes_clamped": build(
        """SELECT image_id, box_id, round(greatest(0.0, least(1.0, (x1 + x2 - 200) / width)), 9) AS xc,
  round(greatest(0.0, least(1.0, (y1 + y2 - 200) / height)), 9) AS yc,
  round(greatest(0.0, least(1.0, 2 * (x2 - x1) / width)), 9) AS bw,
  round(greatest(0.0, least(1.0, 2 * (y2 - y1) / height)), 9) AS bh FROM gt""", "gt"),
    "boxes_in_pixels": build(
        """SELECT image_id, i.width, i.height, box_id, cls, round((g.x1 - g.x2 / 2) * i.width / 10000, 6) AS x1,
  round((g.y1 - g.y2 / 2) * i.height / 10000, 6) AS y1, round((g.x1 + g.x2 / 2) * i.width / 10000, 6) AS x2,
  round((g.y1 + g.y2 / 2) * i.height / 10000, 6) AS y2
FROM images i LEFT JOIN (SELECT * FROM gt WHERE box_id % 7 <> 0 AND box_id % 5 <> 0) g USING (image_id)""", "gt"),
    "boxes_in_int_pixels": build(
        """SELECT image_id, i.width, i.height, box_id, cls,
  CAST(trunc((x1 / 10000 - x2 / 10000 / 2) * i.width) AS INTEGER) AS x1, CAST(trunc((y1 / 10000 - y2 / 10000 / 2) * i.height) AS INTEGER) AS y1,
  CAST(trunc((x1 / 10000 + x2 / 10000 / 2) * i.width) AS INTEGER) AS x2, CAST(trunc((y1 / 10000 + y2 / 10000 / 2) * i.height) AS INTEGER) AS y2
FROM images i LEFT JOIN gt g USING (image_id)""", "gt"),
    "class_names": f"""SELECT cls, {_names('cls', list(DETECTOR_CLASSES))} AS name, {_names('cls', REDUCED)} AS reduced_name, count(*) AS n
FROM (SELECT CAST(l_partkey % 85 AS INTEGER) AS cls FROM lineitem) GROUP BY cls""",
    "tile_starts": build(
        f"""SELECT image_id, CAST(unnest(range(len(s))) AS INTEGER) AS col, CAST(unnest(s) AS INTEGER) AS x1
FROM (SELECT image_id, {_starts('width', 740, 592)} AS s FROM images)""", "images"),
    "fixed_tiles": build('SELECT image_id, "row", col, tile_id, x1, y1, x2, y2 FROM tile_grid', "tiles"),
    "adaptive_plan": build(
        "SELECT image_id, round(share * width * height, 6) AS share_pixels, n_tiles, overlap_px, tile_w, tile_h, step_x, step_y FROM plan", "plan"),
    "adaptive_tiles": build(
        'SELECT image_id, tile_id, "row", col, x1, y1, x2, y2, x1 < 0 OR y1 < 0 AS is_partial FROM adaptive', "adaptive"),
    "tile_base_names": build(
        """SELECT DISTINCT 'a_tile_' || image_id AS base, 'a_tile_' || image_id AS file_base FROM tile_grid""", "tiles"),
    "tile_box_overlaps": build(
        """SELECT image_id, tile_id, box_id, ix1, iy1, ix2, iy2, round((ix2 - ix1) * (iy2 - iy1) / whole, 6) AS visible
FROM cuts""", "cuts"),
    "fixed_tile_boxes": build(f"SELECT image_id, tile_id, box_id, cls, {R9} FROM tile_boxes", "tile_boxes"),
    "adaptive_tile_boxes": build(
        """SELECT * FROM (
  SELECT b.image_id, t.tile_id, b.box_id, b.cls,
    round(((greatest(b.x1, t.x1) + least(b.x2, t.x2)) / 2 - t.x1) / tile_w, 9) AS xc,
    round(((greatest(b.y1, t.y1) + least(b.y2, t.y2)) / 2 - t.y1) / tile_h, 9) AS yc,
    round((least(b.x2, t.x2) - greatest(b.x1, t.x1)) / tile_w, 9) AS bw,
    round((least(b.y2, t.y2) - greatest(b.y1, t.y1)) / tile_h, 9) AS bh
  FROM gt b JOIN adaptive t USING (image_id) WHERE b.x1 < t.x2 AND t.x1 < b.x2 AND b.y1 < t.y2 AND t.y1 < b.y2)
WHERE bw > 0 AND bw <= 1 AND bh > 0 AND bh <= 1""", "adaptive"),
    "tile_labels_with_negatives": build(
        """SELECT image_id, tile_id, count(b.box_id) AS n_boxes FROM tile_grid LEFT JOIN tile_boxes b USING (image_id, tile_id)
GROUP BY image_id, tile_id""", "tile_boxes"),
    "label_sizes": build("SELECT image_id, round(share * width * height, 6) AS share_pixels, overlap_px FROM sizes JOIN images USING (image_id)", "sizes"),
    "tiles_per_axis": build(
        "SELECT split, min(n_tiles) AS min_tiles, max(n_tiles) AS max_tiles, round(avg(n_tiles), 6) AS avg_tiles FROM plan GROUP BY split",
        "plan"),
    "stitched_boxes": build(
        """SELECT image_id, tile_id, box_id, cls, CAST(trunc((xc - bw / 2) * 640 + g.x1) AS INTEGER) AS x1,
  CAST(trunc((yc - bh / 2) * 640 + g.y1) AS INTEGER) AS y1, CAST(trunc((xc + bw / 2) * 640 + g.x1) AS INTEGER) AS x2,
  CAST(trunc((yc + bh / 2) * 640 + g.y1) AS INTEGER) AS y2 FROM tile_boxes JOIN tile_grid g USING (image_id, tile_id)""",
        "tile_boxes"),
    "stitched_totals": build(
        """SELECT image_id, n_rows, n_cols, n_tiles, coalesce(n_boxes, 0) AS n_boxes
FROM (SELECT image_id, max("row") + 1 AS n_rows, max(col) + 1 AS n_cols, count(*) AS n_tiles FROM tile_grid GROUP BY image_id)
LEFT JOIN (SELECT image_id, count(*) AS n_boxes FROM tile_boxes GROUP BY image_id) USING (image_id)""", "tile_boxes"),
    "images_with_labels": build("SELECT image_id, i.split, box_id, cls FROM images i LEFT JOIN gt USING (image_id)", "gt"),
    "merged_detections": build("SELECT * FROM merged", "merged"),
    # The pictures of a crowd lie side by side, so each is merged on its own here.
    "merged_detections_crowded": build(
        """SELECT image_id % 3 AS image_id, image_id AS tile_id, det_id, cls, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2, conf
FROM (SELECT *, 2000.0 * (image_id // 3 % 10000) AS dx, 2000.0 * (image_id // 30000) AS dy FROM odd)""", "odd"),
    "image_errors_crowded": build(
        """SELECT image_id % 3 AS image_id, CAST(sum(missed_gt) AS BIGINT) AS missed_gt, CAST(sum(class_conflicts) AS BIGINT) AS class_conflicts,
  CAST(sum(unused_preds) AS BIGINT) AS unused_preds, sum(missed_gt) > 0 OR sum(class_conflicts) > 0 OR sum(unused_preds) > 0 AS wrong
FROM errors GROUP BY 1""", "errors"),
    "merged_detections_agnostic": build("SELECT * FROM agnostic", "agnostic"),
    "report_boxes": build("SELECT * FROM reported", "reported"),
    "gated_detections": build(
        """SELECT d.image_id, g.tile_id, d.det_id, d.cls, d.x1 + g.x1 AS x1, d.y1 + g.y1 AS y1, d.x2 + g.x1 AS x2, d.y2 + g.y1 AS y2, d.conf
FROM det d JOIN tile_grid g ON g.image_id = d.image_id AND g.tile_id = d.det_id % 2
JOIN tile_scores s ON s.image_id = g.image_id AND s.tile_id = g.tile_id WHERE s.prob > 0.5""", "det", "tile_scores"),
    "candidate_pairs": build("SELECT * REPLACE (round(iou, 6) AS iou, round(conf, 6) AS conf) FROM pairs", "pairs"),
    "candidate_pairs_any_class": build(
        f"""SELECT p.image_id, p.det_id, p.cls, round(p.conf, 6) AS conf, g.box_id, g.cls AS truth_cls, round({iou_sql('p.', 'g.')}, 6) AS iou
FROM merged p JOIN gt g USING (image_id) WHERE {iou_sql('p.', 'g.')} >= 0.5""", "merged", "gt"),
    "best_truth_boxes": build(
        "SELECT image_id, det_id, cls, round(conf, 6) AS conf, round(best_iou, 6) AS best_iou, best_box FROM best", "best"),
    "true_positives": build(
        """SELECT image_id, det_id, cls, round(conf, 6) AS conf, best_box,
  CAST(sum(hit * (1 << CAST(round((iou_thr - 0.5) * 20) AS INTEGER))) AS INTEGER) AS hits
FROM tp GROUP BY image_id, det_id, cls, conf, best_box""", "tp"),
    "precision_recall_curve": build(
        """SELECT cls, iou_thr, rank, CAST(tp_cum AS BIGINT) AS tp_cum, round(precision, 6) AS precision, round(envelope, 6) AS envelope,
  round(tp_cum / (n_gt + 1e-9), 6) AS recall, round(1 / (n_gt + 1e-9), 6) AS recall_step
FROM curve JOIN counts USING (cls)""", "curve", "counts"),
    "class_counts_by_threshold": build(
        "SELECT cls, iou_thr, count(*) AS n_pred, CAST(sum(hit) AS BIGINT) AS tp FROM tp GROUP BY cls, iou_thr", "tp"),
    "average_precision_by_class": build("SELECT cls, iou_thr, n_gt, round(ap, 6) AS ap FROM ap", "ap"),
    "micro_precision_recall": build(
        """SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision,
  round(recall, 6) AS recall FROM micro""", "micro"),
    "mean_average_precisions": build(
        "SELECT round(avg(ap) FILTER (iou_thr = 0.5), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM ap", "ap"),
    "evaluated_classes": build(
        "SELECT CAST(cls + det_id % 3 AS INTEGER) AS cls FROM det UNION SELECT cls FROM gt", "det", "gt"),
    "evaluation": build(
        """SELECT round(precision, 6) AS precision, round(recall, 6) AS recall,
  (SELECT round(avg(ap) FILTER (iou_thr = 0.5), 6) FROM ap) AS map50, (SELECT round(avg(ap), 6) FROM ap) AS map50_95,
  (SELECT count(*) FROM (SELECT cls FROM merged UNION SELECT cls FROM gt)) AS classes_evaluated
FROM micro""", "ap", "micro"),
    "first_matches": build("SELECT image_id, box_id, truth_cls, det_id, pred_cls FROM qfirst", "quality"),
    "image_quality": build(
        """SELECT * REPLACE (round(recall, 12) AS recall, round(precision, 12) AS precision, round(f1_score, 12) AS f1_score,
  round(avg_conf, 12) AS avg_conf, round(quality, 12) AS quality) FROM quality""", "quality"),
    "best_images": build(
        """SELECT * REPLACE (round(recall, 12) AS recall, round(precision, 12) AS precision, round(f1_score, 12) AS f1_score,
  round(avg_conf, 12) AS avg_conf, round(quality, 12) AS quality) FROM quality ORDER BY quality.quality DESC, image_id LIMIT 10""",
        "quality"),
    "image_errors": build(
        "SELECT *, missed_gt > 0 OR class_conflicts > 0 OR unused_preds > 0 AS wrong FROM errors", "errors"),
    "wrong_images": build(
        "SELECT image_id FROM errors WHERE missed_gt > 0 OR class_conflicts > 0 OR unused_preds > 0 ORDER BY image_id LIMIT 10",
        "errors"),
    "gate_kept_tiles": build("SELECT * FROM tile_scores WHERE prob > 0.5", "tile_scores"),
    "gate_totals": build(
        """SELECT images, tiles, kept_tiles, images_with_kept, round(1 - kept_tiles / tiles, 6) AS tile_reduction,
  round(kept_tiles / tiles, 6) AS keep_rate, round(tiles / images, 6) AS tiles_per_image, round(kept_tiles / images, 6) AS kept_per_image
FROM (SELECT count(DISTINCT image_id) AS images, count(*) AS tiles, count(*) FILTER (prob > 0.5) AS kept_tiles,
             count(DISTINCT image_id) FILTER (prob > 0.5) AS images_with_kept FROM tile_scores)""", "tile_scores"),
    "gate_threshold_sweep": build(
        """SELECT threshold, count(*) AS tiles, count(*) FILTER (prob > threshold) AS kept_tiles, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 1 AND prob > threshold) AS recovered,
  round(1 - count(*) FILTER (prob > threshold) / count(*), 6) AS tile_reduction,
  round(count(*) FILTER (label = 1 AND prob > threshold) / count(*) FILTER (label = 1), 6) AS positive_recall
FROM tile_scores CROSS JOIN (SELECT CAST(unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) AS DOUBLE) AS threshold) GROUP BY threshold""",
        "tile_scores"),
    "gate_top_tiles": build(
        """SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, tile_id) AS INTEGER) AS rank
FROM tile_scores QUALIFY rank <= 2""", "tile_scores"),
    "gate_top_k_report": build(
        """SELECT count(*) AS tiles, count(*) FILTER (rk <= 2) AS kept_tiles, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 1 AND rk <= 2) AS recovered, round(1 - count(*) FILTER (rk <= 2) / count(*), 6) AS tile_reduction,
  round(count(*) FILTER (label = 1 AND rk <= 2) / count(*) FILTER (label = 1), 6) AS positive_recall
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY prob DESC, tile_id) AS rk FROM tile_scores)""", "tile_scores"),
    "tile_object_labels": build(
        "SELECT g.image_id, g.tile_id, g.split, s.label FROM tile_grid g JOIN tile_scores s USING (image_id, tile_id)", "tile_scores"),
    "tile_positive_ratio": build("SELECT count(*) AS tiles, round(avg(label), 6) AS positive_ratio FROM tile_scores", "tile_scores"),
    "first_positive_tiles": build(
        """SELECT g.image_id, g.tile_id, g.split, s.label FROM tile_grid g JOIN tile_scores s USING (image_id, tile_id)
WHERE s.label = 1 ORDER BY g.image_id, g.tile_id LIMIT 12""", "tile_scores"),
    "leakage_guard": build(
        """SELECT image_id, tile_id FROM tile_grid WHERE image_id NOT IN (SELECT image_id FROM tile_grid WHERE tile_id = 3)""", "tiles"),
    "tile_colour_features": build(f"SELECT * REPLACE ({_rounded(COLOURS)}) FROM colours", "colours"),
    "tile_features": build(f"SELECT * REPLACE ({_rounded(FEATURES)}) FROM feats", "feats"),
    "gate_standardised_features": build(
        "SELECT image_id, tile_id, label, " + ", ".join(f"round({_scaled(f)}, 6) AS {f}" for f in FEATURES) + " FROM feats", "feats"),
    "gate_class_weights": build(
        "SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 6) AS weight FROM feats GROUP BY label", "feats"),
    "gate_scores_fixed_model": build(
        f"""SELECT image_id, tile_id, label, round(1 / (1 + exp(-z)), 6) AS prob
FROM (SELECT *, -0.5 + {" + ".join(f"{(1 - 2 * (k % 2)) / 8} * {_scaled(f)}" for k, f in enumerate(MODEL))} AS z FROM feats)""", "feats"),
    "image_table_by_split": build("SELECT * FROM images", "images"),
    "train_val_split": build(
        """SELECT image_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || image_id)) <= floor(count(*) OVER () * 0.8::DOUBLE)
  THEN 'train' ELSE 'val' END AS subset FROM images""", "images"),
    "stratified_split": build(
        f"""SELECT image_id, tile_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {STRATUM_KEY})
  <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS subset FROM tile_scores""", "tile_scores"),
    "grouped_split": build(
        """SELECT t.image_id, t.tile_id, subset FROM tile_grid t JOIN (
  SELECT image_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || image_id)) <= ceil(count(*) OVER () * 0.2::DOUBLE)
    THEN 'test' ELSE 'train' END AS subset FROM images) USING (image_id)""", "tiles"),
    "random_image": build("SELECT * FROM images ORDER BY md5('3:' || image_id) LIMIT 1", "images"),
    "first_images": f"SELECT path, split FROM ({_listing('ext')}) ORDER BY split_rank, ext_rank, path LIMIT 25",
    "run_comparison": build(
        """SELECT run, images_processed, tiles_generated, tiles_kept, CAST(NULL AS DOUBLE) AS images_with_kept_tiles,
  CAST(NULL AS DOUBLE) AS tile_reduction, round(total_time, 6) AS total_time, CAST(NULL AS DOUBLE) AS tile_fps,
  CAST(NULL AS DOUBLE) AS real_fps, round(precision, 6) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS map50,
  CAST(NULL AS DOUBLE) AS map50_95, round(tiles_generated / images_processed, 6) AS tiles_per_image,
  round(tiles_kept / images_processed, 6) AS kept_per_image,
  CASE WHEN images_processed IS NOT NULL AND tiles_kept IS NOT NULL THEN coalesce(round(tiles_kept / tiles_generated, 6), 0.0) END AS keep_rate
FROM run_wide""", "run_wide"),
    "run_kept_delta": build(
        """SELECT 'run1' AS first_run, 'run2' AS second_run, round(a, 6) AS first_kept, round(b, 6) AS second_kept, round(a - b, 6) AS kept_difference
FROM (SELECT max(coalesce(tiles_kept, 0) / images_processed) FILTER (run = 'run1') AS a,
             max(coalesce(tiles_kept, 0) / images_processed) FILTER (run = 'run2') AS b FROM run_wide)""", "run_wide"),
    "run_stage_shares": build(
        """SELECT run, stage, round(seconds, 6) AS seconds, round(CASE WHEN total_time <> 0 THEN seconds / total_time END, 6) AS share
FROM (SELECT run, stage, sum(seconds) AS seconds FROM times GROUP BY run, stage
      UNION ALL SELECT run, 'other', any_value(total_time) - sum(seconds) FROM times JOIN totals USING (run) GROUP BY run)
JOIN totals USING (run)""", "times"),
    "run_throughput": build(
        """SELECT run, round(CASE WHEN total_time > 0 THEN n * 3 / total_time ELSE 0.0 END, 6) AS tile_fps,
  round(CASE WHEN total_time > 0 THEN n / nullif(total_time - io - truth, 0) ELSE 0.0 END, 6) AS image_fps
FROM totals JOIN (SELECT run, coalesce(sum(seconds) FILTER (stage = 'io'), 0) AS io,
                         coalesce(sum(seconds) FILTER (stage = 'truth'), 0) AS truth FROM times GROUP BY run) USING (run)""", "times"),
}

# The same evaluation with some predicted classes moved out of the vocabulary.
ORACLE["evaluation_unseen_classes"] = re.sub(
    r"CAST\(cls AS INTEGER\) AS cls, CAST\(x1",
    "CAST(CASE WHEN det_id % 5 = 0 THEN cls + 4 ELSE cls END AS INTEGER) AS cls, CAST(x1",
    ORACLE["evaluation"],
    count=1,
)

ORACLE["gate_scores_stored_model"] = ORACLE["gate_scores_fixed_model"]
# At the lowest point of the loss every slope is 0.
ORACLE["fitted_gate_optimality"] = f"SELECT unnest({[*MODEL, 'intercept']}) AS feature, true AS optimal"
ORACLE["splits_with_null_keys"] = build(
    "SELECT kind, count(*) AS n, count(*) AS n_placed FROM images, (VALUES ('train_val'), ('stratified'), ('grouped')) k(kind) GROUP BY kind",
    "images",
)
# Scores of every 11th detection are missing and of every 13th NaN; the order of numbers per tile is that of whole numbers.
ORACLE["image_quality_by_tile"] = build(
    """SELECT image_id, total_gt, n_pred, coalesce(ok, 0) AS correct_matches, coalesce(bad, 0) AS class_errors,
  n_pred - coalesce(used, 0) AS false_positives, total_gt - coalesce(used, 0) AS missed_gt
FROM quality0 LEFT JOIN (
  SELECT image_id, count(*) FILTER (pred_cls = truth_cls) AS ok, count(*) FILTER (pred_cls <> truth_cls) AS bad, count(DISTINCT det_id) AS used
  FROM (SELECT * FROM qpairs QUALIFY row_number() OVER (PARTITION BY image_id, box_id
    ORDER BY CASE WHEN det_id % 11 = 0 THEN 2 WHEN det_id % 13 = 0 THEN 1 ELSE 0 END,
      CASE WHEN det_id % 11 = 0 OR det_id % 13 = 0 THEN 0 ELSE -conf END, det_id) = 1)
  GROUP BY image_id) USING (image_id)""",
    "quality",
)
