"""Quality rules: base rules on word counts, and boosted trees over document statistics (operator 9).

The trees are fitted on a bounded sample of labelled documents. On chosen features the score may only fall when the
feature rises (or only rise), whatever the data say. A fitted model is a set of flat node arrays; scoring walks all
trees of all documents level by level with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm.labelled import MAX_TRAINING_ROWS, first_rows, fold, training_documents
from boxmill.llm.statistics import COUNTS, FEATURES, measured, with_features
from boxmill.llm.text import extended, without

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5
HOLD_OUT_FOLDS = 5

# -1: the score never rises with the feature.
MONOTONE = {
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "same_neighbour_share": -1,
    "exclamations_per_word": -1,
    "bars_per_word": -1,
}

OUTPUT = dict.fromkeys(COUNTS, "long") | {"base_failed": "boolean", "score": "double", "kept": "boolean"}


@dataclass
class Trees:
    """Flat trees: node i tests ``feature[i] <= threshold[i]`` and goes to ``left[i]`` or ``right[i]``; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.roots):
            return total
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total[start : start + 4096] += self.value[node].sum(axis=1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    l2: float = 1.0,
    bins: int = 64,
    min_rows: int = 10,
) -> Trees:
    """Logistic boosting with second-order leaf values and binned splits.

    ``monotone`` maps a feature's number to +1 or -1. A split on it must order its two values, and the middle of the two
    bounds all later values on either side, so the whole tree keeps the order. Without rows, or with one label only,
    the model is a constant.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
            def worth(gs, hs):
                value = np.clip(-gs / (hs + l2), low, high)
                return value, -(gs * value + 0.5 * (hs + l2) * value * value)

            value, own = worth(g[rows].sum(), h[rows].sum())
            here = len(nodes)
            nodes.append([0, 0.0, here, here, rate * float(value)])
            best = (own + 1e-9, None)
            if level < depth and len(rows) >= 2 * min_rows:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    left, gain_l = worth(gl, hl)
                    right, gain_r = worth(g[rows].sum() - gl, h[rows].sum() - hl)
                    gain = gain_l + gain_r
                    fits = (nl >= min_rows) & (len(rows) - nl >= min_rows) & ((right - left) * monotone.get(j, 0) >= 0)
                    gain = np.where(fits, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, left[k], right[k]))
            if best[1] is not None:
                j, k, left, right = best[1]
                goes_left = binned[rows, j] <= k
                middle = (left + right) / 2
                bound = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone.get(j, 0)]
                nodes[here][0], nodes[here][1] = j, float(edges[j][k])
                nodes[here][2] = grow(rows[goes_left], g, h, *bound[0], level + 1)
                nodes[here][3] = grow(rows[~goes_left], g, h, *bound[1], level + 1)
            return here

        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, 0))
            tree = _flat(nodes, roots[-1:], depth, 0.0)
            margin += tree.margin(x)
    return _flat(nodes, roots, depth, base)


def _flat(nodes: list[list[float]], roots: list[int], depth: int, base: float) -> Trees:
    columns = np.array(nodes, np.float64).reshape(len(nodes), 5).T
    feature, left, right = (columns[k].astype(np.int64) for k in (0, 2, 3))
    return Trees(feature, columns[1], left, right, columns[4], np.array(roots, np.int64), depth, base)


def train(
    documents: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_TRAINING_ROWS
) -> Trees:
    """Fits the trees to ``labels.quality``; by default one fold of five (crc32 of the id) is left out."""
    usable = fold(F.col("doc_id"), HOLD_OUT_FOLDS) != 0 if usable is None else usable
    rows = first_rows(with_features(training_documents(documents, labels, "quality", usable, max_rows)), max_rows)
    table = rows.select("label", "features").toArrow()
    x = np.array(table.column("features").to_pylist(), np.float64).reshape(table.num_rows, len(FEATURES))
    return fit_trees(x, table.column("label").to_numpy().astype(np.float64), {FEATURES.index(k): v for k, v in MONOTONE.items()})


def _judged(texts: list[str | None], model: Trees) -> list[pa.Array]:
    """The columns of OUTPUT for some texts."""
    counts, features = measured(texts)
    n_words, n_repeat = counts[:, 0], counts[:, 4]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    score = model.score(features)
    return [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_FROM))]


def with_verdict(documents: DataFrame, model: Trees) -> DataFrame:
    """``documents`` with the counts, ``base_failed``, ``score`` and ``kept`` in place of the text, in one pass without a shuffle.

    A null or empty text has no words and fails the base rules. Columns of ``documents`` that bear a name of the output
    are replaced. Repeated rows are judged alike, rows with a null id like any other.
    """
    df = without(documents, list(OUTPUT))
    names = [c for c in df.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = _judged(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names=[*names, *OUTPUT])

    return df.mapInArrow(rows, extended(df.select([f"`{c}`" for c in names]).schema, OUTPUT))


def kept_documents(documents: DataFrame, model: Trees) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_judged(batch.column("text").to_pylist(), model)[-1])

    return documents.mapInArrow(rows, documents.schema)
