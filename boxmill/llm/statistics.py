"""Statistics of one document, as counts and as model features.

A null text counts as an empty one: all counts and features are zero. A text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxmill.llm.text import BLANKS, SYMBOLS, extended, repeated_window_words, word_ids, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "word_length",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "same_neighbour_share",
    "distinct_share",
    "top_word_share",
    "upper_share",
    "exclamations_per_word",
    "bars_per_word",
    "digit_share",
    "stops_per_word",
    "commas_per_word",
    "words_per_line",
)
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS and the values of FEATURES for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    items = words(raw)
    n = len(items)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), (0.0,) * len(FEATURES)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    ids = word_ids(items)
    repeats = repeated_window_words(ids)
    uses = np.bincount(ids)
    features = (
        float(np.log1p(n)),
        chars / n,
        symbols / n,
        dup_lines / len(lines),
        repeats / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        len(uses) / n,
        float(uses.max()) / n if n >= 20 else 0.0,
        (len(raw) - len(raw.translate(None, _UPPER))) / len(raw),
        text.count("!") / n,
        text.count("|") / n,
        (len(raw) - len(raw.translate(None, _DIGITS))) / len(raw),
        text.count(".") / n,
        text.count(",") / n,
        n / len(lines),
    )
    return (n, chars, symbols, dup_lines, repeats), features


def measured(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (long) and features (double) of many texts, a row each."""
    pairs = [measure(t) for t in texts]
    counts = np.array([p[0] for p in pairs], np.int64).reshape(len(pairs), len(COUNTS))
    features = np.array([p[1] for p in pairs], np.float64).reshape(len(pairs), len(FEATURES))
    return counts, features


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text column by ``features``, an array in the order of FEATURES."""
    kept = [c for c in df.columns if c != text]
    schema = extended(df.select(kept).schema, {"features": "array<double>"})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, features = measured(batch.column(text).to_pylist())
            values = pa.array(list(features), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [values], names=[*kept, "features"])

    return df.mapInArrow(rows, schema)


