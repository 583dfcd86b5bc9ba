"""A corpus from raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the docs of
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxmill.llm import decontaminate, mixing, near_copies, quality_rules, sharding
from boxmill.session import write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and the trees, which learn from the labels of the given documents.

    Null, empty and very short texts fail the base rules and go; very long ones are measured whole. Repeated rows share their fate, an
    empty table stays empty, and further columns pass through whatever their names.
    """
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: 80 % or more of their five-word shingles in common.

    SimHash, as in operator 4, proposes pairs first; MinHash bands propose those beyond its four bits. Every pair is checked exactly.
    The smallest id stays, a null id last; of equal rows one. Null and empty texts are one group. Very long texts are compared whole, an
    empty table stays empty, and further columns pass through whatever their names.
    """
    return near_copies.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window.

    Null and empty texts hold none and stay, very long ones are scanned whole, repeated rows share their fate. An empty table stays empty,
    and further columns pass through whatever their names.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks for: up to three times, or not at all.

    A null source is a source, null and empty texts have size 0 and are taken like others of their source. Ties of size go by id; repeated
    rows are documents of their own. An empty table stays empty, and further columns pass through whatever their names.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None, earlier: int | None = None) -> DataFrame:
    """Adds ``virtual_slot`` and ``shard`` by a stored slot table: version 1, or ``earlier`` of ``folder`` rebalanced.

    Null and empty texts weigh 8 bytes, very long ones what they have; rows that agree in id and text share a slot. An empty table
    stays empty. Columns of the two names are replaced, all others pass through.
    """
    return sharding.with_shard(docs, sharding.versioned(spark, sharding.slot_totals(docs), folder, earlier))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

# Near copies and boosted trees are beyond SQL: tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
