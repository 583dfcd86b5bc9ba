"""Plain loops written from the definitions, to check the DataFrame forms on small inputs."""

import numpy as np


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    size = sum(max(0.0, c[2] - c[0]) * max(0.0, c[3] - c[1]) for c in (a, b))
    return w * h / max(size - w * h, 1e-9)


def box(row):
    return row["x1"], row["y1"], row["x2"], row["y2"]


def in_order(rows):
    return sorted(rows, key=lambda r: (-r["conf"], r["image_id"], r["det_id"]))


def nms(rows, threshold, max_det=300, agnostic=False):
    """Class-wise walk with a limit per class, then a limit on the merged list."""
    result = []
    for image in {r["image_id"] for r in rows}:
        mine = in_order([r for r in rows if r["image_id"] == image])
        kept = []
        for cls in {None} if agnostic else {r["cls"] for r in mine}:
            group = []
            for r in mine:
                if cls is not None and r["cls"] != cls:
                    continue
                if max_det and len(group) >= max_det:
                    break
                if all(iou(box(r), box(k)) <= threshold for k in group):
                    group.append(r)
            kept += group
        kept = in_order(kept)
        result += kept[:max_det] if max_det else kept
    return result


def match(preds, truth, cls, threshold):
    """Hits of one class in score order, and the number of truth boxes."""
    taken, hits = set(), []
    for p in in_order([p for p in preds if p["cls"] == cls]):
        mine = sorted([t for t in truth if t["cls"] == cls and t["image_id"] == p["image_id"]], key=lambda t: t["box_id"])
        values = [iou(box(p), box(t)) for t in mine]
        hit = False
        if values:
            best = int(np.argmax(values))
            key = (p["image_id"], mine[best]["box_id"])
            if values[best] >= threshold and key not in taken:
                taken.add(key)
                hit = True
        hits.append(hit)
    return hits, sum(t["cls"] == cls for t in truth)


def average_precision(hits, n_gt):
    tp = np.cumsum(hits)
    recall = np.concatenate(([0.0], tp / (n_gt + 1e-9), [1.0]))
    precision = np.concatenate(([0.0], tp / (np.arange(1, len(hits) + 1) + 1e-9), [0.0]))
    for i in range(len(precision) - 2, -1, -1):
        precision[i] = max(precision[i], precision[i + 1])
    return sum((recall[i + 1] - recall[i]) * precision[i + 1] for i in range(len(recall) - 1))


def evaluate(preds, truth, thresholds):
    tp = fp = fn = 0
    table = {}
    for cls in sorted({t["cls"] for t in truth}):
        for k, t in enumerate(thresholds):
            hits, n_gt = match(preds, truth, cls, t)
            table[cls, t] = average_precision(hits, n_gt)
            if k == 0:
                tp, fp, fn = tp + sum(hits), fp + len(hits) - sum(hits), fn + n_gt - sum(hits)
    return {
        "precision": tp / (tp + fp + 1e-9),
        "recall": tp / (tp + fn + 1e-9),
        "map50": float(np.mean([v for (_, t), v in table.items() if t == thresholds[0]])) if table else 0.0,
        "map50_95": float(np.mean(list(table.values()))) if table else 0.0,
    }, table
