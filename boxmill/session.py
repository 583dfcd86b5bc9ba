"""Session helpers: where intermediate tables live and how small tables are recognised."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Shuffle files go when the query that wrote them has ended (Spark 4.1; of no effect in earlier versions).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Rows a helper table may have before it is no longer sent through the driver.
MAX_LISTED_ROWS = 20_000

_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder.

    A local session without one gets a temporary folder; a cluster session must name a folder
    that every executor sees.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="boxmill-")
    return _local_folders[application]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run here leave no shuffle files. Otherwise those of all steps lie on the disks until the driver happens to collect garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. What was shuffled for it is removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boxmill/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, name: str = "helper") -> tuple[DataFrame, int | None]:
    """Evaluate a table that is expected to be small, once, and check that it is.

    Up to ``MAX_LISTED_ROWS`` rows it becomes a local table marked for broadcast, returned with its row
    count. Beyond that it is written out, joins on it shuffle, and the count is None.
    """
    with shuffles_removed(df.sparkSession):
        rows = df.limit(MAX_LISTED_ROWS + 1).toArrow()
    if rows.num_rows > MAX_LISTED_ROWS:
        return write_table(df, name), None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows.num_rows
