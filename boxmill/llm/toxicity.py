"""Toxicity by multiple-instance learning (operator 8).

A document is a bag of sentences. Each sentence has a probability, a logistic model of its words and word beginnings;
the document's is their noisy-or: toxic unless every sentence is clean. Weights are learned from document labels
only, through the noisy-or, and then point at the sentences to blame.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm.labelled import MAX_TRAINING_ROWS, first_rows, fold, training_documents
from boxmill.llm.text import extended, without
from boxmill.session import write_table

HOLD_OUT_FOLDS = 3
HELD_OUT = 1
PREDICT_FROM = 0.7
BLAME_FROM = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
# Lengths of word beginnings, written with a hyphen: inflected forms of an unseen ending share them.
BEGINNINGS = (4, 5, 6)


# Different words whose tokens a task remembers.
REMEMBERED = 200_000


def word_tokens(word: str) -> list[str]:
    """A lower-case word and its beginnings, if it is longer."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def tokens(sentence: str) -> set[str]:
    """The lower-case words of a sentence and the beginnings of longer words."""
    return {t for w in set(_WORD.findall(sentence.lower())) for t in word_tokens(w)}


class Lexicon(dict):
    """The numbers of a word's known tokens, looked up once per word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(self.vocabulary[t] for t in word_tokens(word) if t in self.vocabulary)
        return found


def bags(text: str | None, lexicon: Lexicon) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """``start, end`` and the known tokens of every sentence with a word, in order."""
    for m in _SENTENCE.finditer(text or ""):
        if m[0].strip():
            found: set[int] = set()
            for word in set(_WORD.findall(m[0].lower())):
                found.update(lexicon[word])
            yield m.start(), m.end(), tuple(sorted(found))


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.lexicon = Lexicon(self.vocabulary)

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """``start, end, probability`` of every sentence."""
        return [(a, b, 1 / (1 + np.exp(-self._z(ids)))) for a, b, ids in bags(text, self.lexicon)]

    def _z(self, ids: tuple[int, ...]) -> float:
        return float(np.clip(self.bias + sum(self.weights[i] for i in ids), -30, 30))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a document and the sentences to blame."""
        found = self.sentences(text)
        clean = sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)
        return float(-np.expm1(clean)), [s for s in found if s[2] >= BLAME_FROM]


def choose_tokens(sample: DataFrame) -> list[str]:
    """The tokens typical of toxic documents: in three or more, and over four times as likely there as in others.

    Counted on Spark over the sample, whose rows bound their number; all that meet the rule get a weight.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[label].update(tokens(text or ""))
            names = list(seen[0].keys() | seen[1].keys())
            clean, toxic = ([c[t] for t in names] for c in seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["token", "clean", "toxic"]
            )

    totals = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    if not n.get(0) or not n.get(1):
        return []
    counts = sample.select("text", "label").mapInArrow(count, "token string, clean long, toxic long")
    counts = counts.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3")
    rate_clean, rate_toxic = (F.col("clean") + 0.5) / (n[0] + 1.0), (F.col("toxic") + 0.5) / (n[1] + 1.0)
    return sorted(r["token"] for r in counts.where(rate_toxic > 4 * rate_clean).select("token").collect())


def fit(vocabulary: dict[str, int], labels: np.ndarray, sentences: list[list[tuple[int, ...]]], empty: np.ndarray, steps: int = 400) -> Model:
    """Maximum likelihood of the document labels under the noisy-or, by Adam on the whole sample.

    ``sentences`` holds each document's sentences with a known token, ``empty`` the number of its other sentences.
    """
    size = len(vocabulary)
    rows = [(d, s) for d, own in enumerate(sentences) for s in own]
    owner = np.array([d for d, _ in rows], np.int64)
    sentence = np.repeat(np.arange(len(rows)), [len(s) for _, s in rows]) if rows else np.zeros(0, np.int64)
    feature = np.fromiter((f for _, s in rows for f in s), np.int64)
    theta = np.zeros(size + 1)
    share = (labels.mean() if len(labels) else 0.0) * 0.05 + 1e-6
    theta[-1] = np.log(share / (np.mean([len(s) for s in sentences] + empty) + 1.0)) if len(labels) else -8.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if len(labels) else 1):
        z = np.clip(theta[-1] + np.bincount(sentence, theta[feature], len(rows)), -30, 30)
        bare = np.clip(theta[-1], -30, 30)
        mass = np.bincount(owner, np.logaddexp(0, z), len(labels)) + empty * np.logaddexp(0, bare)
        mass = np.maximum(mass, 1e-9)
        pull = np.where(labels == 1, -np.exp(-mass) / -np.expm1(-mass), 1.0)
        by_sentence = pull[owner] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(feature, by_sentence[sentence], size), by_sentence.sum() + (pull * empty).sum() / (1 + np.exp(-bare)))
        gradient = gradient / len(labels) + 1e-5 * np.append(theta[:-1], 0.0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(vocabulary, theta[:-1], float(theta[-1]))


def train(
    documents: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_TRAINING_ROWS
) -> Model:
    """Learns from ``labels.toxic``; by default one fold of three (crc32 of the id) is left out.

    The sample is written once, so that the corpus is searched for it once. Its documents come to the driver as lists of
    chosen token numbers per sentence, without texts.
    """
    usable = fold(F.col("doc_id"), HOLD_OUT_FOLDS) != HELD_OUT if usable is None else usable
    sample = write_table(training_documents(documents, labels, "toxic", usable, max_rows), "toxicity-sample")
    vocabulary = {t: i for i, t in enumerate(choose_tokens(sample))}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(vocabulary)
        for batch in batches:
            known, bare = [], []
            for text in batch.column("text").to_pylist():
                own = [ids for _, _, ids in bags(text, lexicon)]
                known.append([ids for ids in own if ids])
                bare.append(sum(not ids for ids in own))
            arrays = [batch.column("doc_id"), batch.column("label"), pa.array(known, pa.list_(pa.list_(pa.int32()))), pa.array(bare, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "known", "bare"])

    schema = extended(sample.select("doc_id", "label").schema, {"known": "array<array<int>>", "bare": "long"})
    table = first_rows(sample.mapInArrow(reduce, schema), max_rows).toArrow()
    known = [[tuple(s) for s in own] for own in table.column("known").to_pylist()]
    return fit(vocabulary, table.column("label").to_numpy(), known, table.column("bare").to_numpy().astype(np.float64))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score`` and ``offending`` (start, end and probability of sentences) in place of the text.

    A null or empty text has no sentences and the score 0. Repeated rows stay, very long texts are read whole, an empty table
    gives an empty result. Columns of these names are replaced. One pass, no shuffle.
    """
    df = without(documents, ["score", "offending"])
    names = [c for c in df.columns if c != "text"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            blame = [[{"start": a, "end": b, "probability": p} for a, b, p in f[1]] for f in found]
            added = [pa.array([f[0] for f in found], pa.float64()), pa.array(blame, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names=[*names, "score", "offending"])

    added = {"score": "double", "offending": "array<struct<start:int,end:int,probability:double>>"}
    return df.mapInArrow(rows, extended(df.select([f"`{c}`" for c in names]).schema, added))
