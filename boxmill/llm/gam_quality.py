"""Quality classifier: a generalised additive model with pairwise interactions (operator 5).

Boosting goes round the features; each step fits a tree of at most four leaves on one feature's bins and adds it to
that feature's lookup table. The strongest pairs of features then get two-dimensional tables in the same way. A score
is the sum of one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm.labelled import MAX_TRAINING_ROWS, first_rows, fold, training_documents
from boxmill.llm.statistics import FEATURES, measured, with_features
from boxmill.llm.text import extended, without

HOLD_OUT_FOLDS = 5
PREDICT_FROM = 0.3
BINS = 48
PAIR_BINS = 12
PAIRS = 8


@dataclass
class Tables:
    """Bin edges, one table per feature, and two-dimensional tables for pairs (on coarser edges)."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    main: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]
    intercept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.main)):
            total += table[np.searchsorted(edges, x[:, j])]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def _cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; no cut has gain 0."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2) - g.sum() ** 2 / (h.sum() + l2)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _step(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """A tree of depth two on one feature: its value per bin."""
    out = np.empty(len(g))
    _, middle = _cut(g, h, l2)
    for low, high in ((0, middle), (middle, len(g))):
        if high > low:
            k = low + _cut(g[low:high], h[low:high], l2)[1]
            for a, b in ((low, k), (k, high)):
                out[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """A tree that cuts the first feature, then each side on the second: its gain and its value per cell."""
    best = (-1.0, 0, 0, 0)
    for k in range(1, max(2, len(g))):
        halves = [(g[:k].sum(0), h[:k].sum(0)), (g[k:].sum(0), h[k:].sum(0))]
        cuts = [_cut(*half, l2) for half in halves]
        gain = sum(c[0] for c in cuts) + sum(a.sum() ** 2 / (b.sum() + l2) for a, b in halves)
        if gain > best[0]:
            best = (gain, k, cuts[0][1], cuts[1][1])
    out = np.empty_like(g)
    for rows, k in ((slice(0, best[1]), best[2]), (slice(best[1], None), best[3])):
        for cols in (slice(0, k), slice(k, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return best[0], out


def fit_tables(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, l2: float = 2.0) -> Tables:
    """Cyclic boosting of the logistic loss. Without rows, or with one label only, the tables are zero."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(share / (1 - share)))
    n = x.shape[1]
    if not len(y) or y.sum() in (0, len(y)):
        nothing = [np.zeros(0)] * n
        return Tables(nothing, nothing, [np.zeros(1)] * n, {}, intercept)
    edges, coarse = _edges(x, BINS), _edges(x, PAIR_BINS)
    bins = [np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]
    cells = [np.searchsorted(e, x[:, j]) for j, e in enumerate(coarse)]
    main = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(main):
            g, h = slopes()
            step = rate * np.clip(_step(*(np.bincount(bins[j], v, len(table)) for v in (g, h)), l2), -4, 4)
            table += step
            margin += step[bins[j]]

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        place = cells[a] * shape[1] + cells[b]
        return _pair_step(*(np.bincount(place, v, shape[0] * shape[1]).reshape(shape) for v in slopes()), l2)

    strongest = sorted(((grid(a, b)[0], a, b) for a, b in combinations(range(n), 2)), reverse=True)[:PAIRS]
    pairs = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for _, a, b in strongest}
    for _ in range(rounds // 4):
        for (a, b), table in pairs.items():
            step = rate * np.clip(grid(a, b)[1], -4, 4)
            table += step
            margin += step[cells[a], cells[b]]
    return Tables(edges, coarse, main, pairs, intercept)


def train(
    documents: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_TRAINING_ROWS
) -> Tables:
    """Fits the tables to ``labels.quality``; by default one fold of five (crc32 of the id) is left out."""
    usable = fold(F.col("doc_id"), HOLD_OUT_FOLDS) != 0 if usable is None else usable
    rows = first_rows(with_features(training_documents(documents, labels, "quality", usable, max_rows)), max_rows)
    table = rows.select("label", "features").toArrow()
    x = np.array(table.column("features").to_pylist(), np.float64).reshape(table.num_rows, len(FEATURES))
    return fit_tables(x, table.column("label").to_numpy().astype(np.float64))


def scored(documents: DataFrame, model: Tables) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) in place of the text, in one pass without a shuffle.

    A null text is scored like an empty one. A column named ``score`` is replaced.
    """
    df = without(documents, ["score"])
    names = [c for c in df.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(measured(batch.column("text").to_pylist())[1]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [score], names=[*names, "score"])

    return df.mapInArrow(rows, extended(df.select([f"`{c}`" for c in names]).schema, {"score": "double"}))
