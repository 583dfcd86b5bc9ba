"""SimHash near-duplicates by anchor points (operator 4).

A fingerprint has 64 bits in three blocks of 22, 21 and 21. Two fingerprints that differ in at most four bits differ
in at most one bit of some block. Per block, a covering code names the anchors: a Hamming code on the lowest 15 bits
and every value of the rest, so that each block value lies within the covering radius 1 of one anchor, its home. A
fingerprint is sent home and to every anchor within radius plus block threshold (1 + 1). If two values differ in one bit
at most, the second one therefore meets the first at the first one's home, and only homes are compared with guests.

Only different fingerprints take part. Links of a batch are reduced to a spanning set before they leave the task,
so a crowd of near copies gives rows in proportion to its size, not to its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.llm.components import connected_components, spanning_links
from boxmill.llm.text import KEY, extended, key_columns, utf8, words
from boxmill.session import small_table, write_table

SHINGLE_WORDS = 4
THRESHOLD = 4
SEED = 42

# First bit and width of each block; THRESHOLD + 1 blocks are not needed, as each may differ in one bit.
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15

# Fingerprints at one home beyond which the home is dealt out in parts, each met by all guests.
HOME_ROWS = 8192
# Pairs compared at once inside a task.
PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: bytes | None) -> int:
    """The SimHash of one UTF-8 text as an unsigned number; zero without words.

    Bit i is set if it is set in more than half of the shingles' XXH64 values, repeats included.
    """
    items = words((text or b"").lower())
    if not items:
        return 0
    joined = b" ".join(items)
    ends = np.cumsum([len(w) + 1 for w in items]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE_WORDS, len(items))
    spans = zip(starts[: len(items) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` (a signed long) per row; ``text_hash`` is the text's 64-bit hash."""
    rows_in = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = extended(rows_in.select("doc_id", "text_hash").schema, {"fingerprint": "long"})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fingerprint"]
            )

    return rows_in.mapInArrow(rows, schema)


@cache
def _code() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value its nearest code word, and all code words within two bits (own one first, -1 for none)."""
    values = np.arange(1 << CODE_BITS)
    syndrome = np.zeros_like(values)
    for position in range(1, CODE_BITS + 1):
        syndrome ^= np.where(values >> (position - 1) & 1, position, 0)
    flip = np.concatenate([[0], 1 << np.arange(CODE_BITS)])
    nearest = values ^ flip[syndrome]
    near = np.full((len(values), 8), -1)
    near[:, 0] = nearest
    for s in range(1, CODE_BITS + 1):
        pairs = [(i, i ^ s) for i in range(1, CODE_BITS + 1) if i < (i ^ s)]
        mine = np.flatnonzero(syndrome == s)
        for k, (i, j) in enumerate(pairs):
            near[mine, k + 1] = mine ^ flip[i] ^ flip[j]
    return nearest, near


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, is_guest, row`` of unsigned fingerprints: one home and all guest places per block.

    Anchors that differ in two of the free bits are left out: the home of a value one bit away differs in one at most.
    """
    nearest, near = _code()
    places, guests, rows = [], [], []
    index = np.arange(len(values))
    for number, (first, width) in enumerate(BLOCKS):
        block = (values >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        code, free = block & ((1 << CODE_BITS) - 1), block >> CODE_BITS
        mark = number << 22
        home = mark | (free << CODE_BITS) | nearest[code]
        around = np.where(near[code] >= 0, mark | (free[:, None] << CODE_BITS) | near[code], -1)
        flipped = home[:, None] ^ (1 << np.arange(CODE_BITS, width))
        guest = np.concatenate([around, flipped], axis=1)
        owner = np.broadcast_to(index[:, None], guest.shape)
        there = guest >= 0
        places += [home, guest[there]]
        guests += [np.zeros(len(home), np.int8), np.ones(there.sum(), np.int8)]
        rows += [index, owner[there]]
    return np.concatenate(places), np.concatenate(guests), np.concatenate(rows)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fingerprint").to_numpy().view(np.uint64)
        for k in range(0, len(values), 8192):
            part = values[k : k + 8192]
            anchor, guest, row = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int32)), pa.array(guest), pa.array(part[row].view(np.int64))],
                names=["anchor", "is_guest", "fingerprint"],
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by anchor, part and role, homes first. Homes of the last anchor are carried on."""
    key_left, value_left = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = (batch.column("anchor").to_numpy().astype(np.int64) << 32) | batch.column("part").to_numpy()
        value = batch.column("fingerprint").to_numpy().view(np.uint64)
        home = batch.column("is_guest").to_numpy() == 0
        home_key, home_value = np.concatenate([key_left, key[home]]), np.concatenate([value_left, value[home]])
        guest_key, guest_value = key[~home], value[~home]
        low = np.searchsorted(home_key, guest_key, "left")
        many = np.searchsorted(home_key, guest_key, "right") - low
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        at = 0
        upto = np.cumsum(many)
        while at < len(many):
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
            n = many[at:end]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            homes = home_value[np.repeat(low[at:end], n) + offset]
            guests = np.repeat(guest_value[at:end], n)
            linked = (np.bitwise_count(homes ^ guests) <= THRESHOLD) & (homes != guests)
            if linked.any():
                found.append(spanning_links(homes[linked], guests[linked]))
            at = end
        if len(found) > 1:
            a, b = spanning_links(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        still = home_key == key[-1]
        key_left, value_left = home_key[still], home_value[still]


def links(distinct: DataFrame, home_rows: int = HOME_ROWS) -> DataFrame:
    """``a, b``: links that join exactly the fingerprints within THRESHOLD bits, directly or over others.

    ``distinct`` holds each fingerprint once. A home with more than ``home_rows`` fingerprints is dealt out in parts by hash.
    """
    placed = distinct.select("fingerprint").mapInArrow(_placed, "anchor int, is_guest byte, fingerprint long")
    homes = placed.where("is_guest = 0").groupBy("anchor").count().where(F.col("count") > home_rows)
    crowded, n = small_table(homes.select("anchor", F.ceil(F.col("count") / home_rows).cast("int").alias("parts")), "crowded")
    if n == 0:
        placed = placed.withColumn("part", F.lit(0))
    else:
        placed = placed.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.array(F.pmod(F.hash("fingerprint"), F.col("parts")))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        placed = placed.withColumn("part", F.explode(F.when(F.col("is_guest") == 0, own).otherwise(every)))
    dealt = placed.select("anchor", "part", "is_guest", "fingerprint").repartition("anchor", "part")
    return dealt.sortWithinPartitions("anchor", "part", "is_guest").mapInArrow(_met, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fingerprint, root`` per row: rows with an equal ``root`` are near-duplicates of each other.

    A null or empty text has the fingerprint zero and is linked like any other. Repeated rows and repeated or null
    ids stay rows of their own; an empty table gives an empty result. Other columns are not read.
    """
    prints = write_table(fingerprints(documents), "fingerprints")
    roots = connected_components(links(prints.select("fingerprint").distinct()))
    # Only fingerprints with a link are in ``roots``; a hot fingerprint on the other side is split by Spark.
    return (
        prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("doc_id", "text_hash", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))
    )


def with_component(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` of the component.

    A component of null ids only has a null ``component_id``.
    """
    found = write_table(near_duplicates(documents), "near-duplicates")
    # Written out, so that both sides of the join are dealt anew and Spark can split a hot component.
    smallest = write_table(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return found.join(smallest, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each component: the smallest id (nulls last), then the smallest text hash; of equal rows any one."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = near_duplicates(documents).groupBy("root").agg(F.min(order).alias("best"))
    best = best.select(*key_columns("best.doc_id", "best.text_hash"))
    keyed = documents.select(F.struct("*").alias("row"), *key_columns("doc_id", F.xxhash64("text")))
    return keyed.join(best, KEY, "left_semi").dropDuplicates(KEY).select("row.*")
