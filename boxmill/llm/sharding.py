"""Sharding over fixed virtual slots (operator 10).

Records are hashed to a fixed number of virtual slots. Bytes are summed per slot, and a small table assigns slots to
shards so that shard sizes come out near equal (law ``bytes``). The table is stored with a version; rebalancing
edits as few entries as it can and stores the next version.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxmill.llm.text import without
from boxmill.session import shared_dir

VIRTUAL_SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed part per record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def virtual_slot(doc_id: Column, text: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    """The slot of a record, from its id and text: many rows under one id, or under none, still spread out."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), text), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class Slot:
    """One entry of the slot table."""

    virtual_slot: int
    shard: int
    rows: int
    bytes: int


def slot_totals(documents: DataFrame, slots: int = VIRTUAL_SLOTS) -> list[tuple[int, int, int]]:
    """``slot, rows, bytes`` of the slots in use: at most ``slots`` rows, summed on Spark."""
    sums = (
        documents.select(virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("slot"), record_bytes(F.col("text")).alias("size"))
        .groupBy("slot")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    )
    return sorted(tuple(r) for r in sums.collect())


def assign(totals: list[tuple[int, int, int]], shards: int = SHARDS) -> list[Slot]:
    """A new slot table: the largest slot first, always to the shard with the fewest bytes so far.

    Ties go to the lower slot and the lower shard. A single record, or many equal records of one slot, can make a shard
    larger than the mean; nothing else can by more than its last slot.
    """
    heap = [(0, s) for s in range(shards)]
    table = []
    for slot, rows, size in sorted(totals, key=lambda t: (-t[2], t[0])):
        filled, shard = heapq.heappop(heap)
        heapq.heappush(heap, (filled + size, shard))
        table.append(Slot(slot, shard, rows, size))
    return sorted(table, key=lambda s: s.virtual_slot)


def rebalance(table: list[Slot], totals: list[tuple[int, int, int]], shards: int) -> list[Slot]:
    """The next version of a table for new totals and ``shards`` shards, moving few slots.

    Slots keep their shard where it still exists; new slots and those of closed shards go to the emptiest shard.
    Then slots move from the fullest to the emptiest shard while a move narrows the gap between the two.
    """
    home = {s.virtual_slot: s.shard for s in table if s.shard < shards}
    members: list[dict[int, int]] = [{} for _ in range(shards)]
    homeless = []
    for slot, _, size in totals:
        if slot in home:
            members[home[slot]][slot] = size
        else:
            homeless.append((size, slot))
    filled = [sum(m.values()) for m in members]
    for size, slot in sorted(homeless, reverse=True):
        shard = min(range(shards), key=lambda s: (filled[s], s))
        members[shard][slot] = size
        filled[shard] += size
    for _ in range(len(totals)):
        full, bare = max(range(shards), key=lambda s: filled[s]), min(range(shards), key=lambda s: filled[s])
        half = (filled[full] - filled[bare]) / 2
        fitting = [(size, slot) for slot, size in members[full].items() if 0 < size <= half]
        if not fitting:
            break
        size, slot = max(fitting)
        members[bare][slot] = members[full].pop(slot)
        filled[full] -= size
        filled[bare] += size
    shard_of = {slot: s for s, m in enumerate(members) for slot in m}
    return [Slot(slot, shard_of[slot], rows, size) for slot, rows, size in sorted(totals)]


def table_frame(spark: SparkSession, table: list[Slot]) -> DataFrame:
    """The slot table as a DataFrame of at most the fixed number of slots; ``first_row`` is where a slot starts in its shard."""
    rows, filled = [], {}
    for s in table:
        rows.append((s.virtual_slot, s.shard, s.rows, s.bytes, filled.get(s.shard, 0)))
        filled[s.shard] = filled.get(s.shard, 0) + s.rows
    return spark.createDataFrame(rows, "virtual_slot int, shard int, rows long, bytes long, first_row long").coalesce(1)


def store(spark: SparkSession, table: list[Slot], folder: str, version: int) -> None:
    """Writes a version of the slot table; a version is never overwritten."""
    table_frame(spark, table).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load(spark: SparkSession, folder: str, version: int) -> list[Slot]:
    """A stored version of the slot table."""
    rows = spark.read.parquet(f"{folder}/version={version}").select("virtual_slot", "shard", "rows", "bytes").collect()
    return sorted((Slot(*r) for r in rows), key=lambda s: s.virtual_slot)


def versioned(spark: SparkSession, totals: list[tuple[int, int, int]], folder: str | None = None, earlier: int | None = None, shards: int = SHARDS) -> list[Slot]:
    """Stores the next version of the slot table and gives it as read back.

    Without an ``earlier`` version that is version 1, dealt anew; with one, that version of ``folder`` is rebalanced. Without
    a ``folder`` the table goes to one of its own in the shared folder.
    """
    folder = folder or f"{shared_dir(spark)}/boxmill/slots-{uuid.uuid4().hex}"
    table = assign(totals, shards) if earlier is None else rebalance(load(spark, folder, earlier), totals, shards)
    version = 1 if earlier is None else earlier + 1
    store(spark, table, folder, version)
    return load(spark, folder, version)


def with_shard(documents: DataFrame, table: list[Slot], slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``documents`` with ``virtual_slot`` and ``shard`` added, without a shuffle; the table of fixed size is broadcast.

    Rows with null ids or texts have slots like any other, equal rows share one. Columns of these names are replaced.
    """
    small = table_frame(documents.sparkSession, table).select("virtual_slot", "shard")
    slot = virtual_slot(F.col("doc_id"), F.col("text"), slots)
    own = without(documents, ["virtual_slot", "shard"]).withColumn("virtual_slot", slot)
    columns = [c for c in own.columns if c != "virtual_slot"]
    joined = own.join(F.broadcast(small), "virtual_slot")
    return joined.select(*(F.col(f"`{c}`") for c in columns), "virtual_slot", "shard")


def placed(documents: DataFrame, table: list[Slot], slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, slot``: ``slot`` numbers the rows of a shard from 0 without gaps.

    The number is the place inside the virtual slot after the rows of the shard's earlier slots, so no task sees a
    whole shard. Equal rows take neighbouring places in any order.
    """
    rows = documents.select(
        "doc_id",
        record_bytes(F.col("text")).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    )
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    small = table_frame(documents.sparkSession, table).select("virtual_slot", "shard", "first_row")
    joined = rows.withColumn("inside", inside).join(F.broadcast(small), "virtual_slot")
    slot = (F.col("first_row") + F.col("inside") - 1).alias("slot")
    return joined.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", slot)
