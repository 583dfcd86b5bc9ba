"""The bounded sample of labelled documents that models learn from, and the fold rule that keeps rows out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled documents a model learns from at most. Below it all are taken; beyond it those with the smallest hash of
# their id. Only fitting is bounded: scoring covers every document.
MAX_TRAINING_ROWS = 20_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id belongs to fold 0."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(folds))


def unambiguous(labels: DataFrame, label: str) -> DataFrame:
    """One row ``doc_id, label`` per labelled document.

    Null ids and labels are dropped, repeated rows count once, and a document labelled both ways has no label.
    """
    clean = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    clean = clean.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return (
        clean.groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("highest"))
        .where(F.col("label") == F.col("highest"))
        .drop("highest")
    )


def training_documents(
    documents: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int = MAX_TRAINING_ROWS
) -> DataFrame:
    """``doc_id, text, label`` of at most ``max_rows`` labelled ids for which ``usable`` (on ``doc_id``) holds.

    The id list is cut to ``max_rows`` before it is broadcast. An id that repeats in ``documents`` brings all its rows;
    ``first_rows`` bounds them after the texts have become numbers.
    """
    ids = unambiguous(labels, label).where(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def first_rows(rows: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``max_rows`` rows, by the hash of their id, in a stable order."""
    return rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(max_rows)
