"""Near copies by word shingles (the pipeline's near_dedup stage).

Two texts are near copies if they share at least 80 % of their different five-word shingles. SimHash (operator 4) proposes the
texts whose fingerprints differ in at most four bits. Most pairs at the measure differ in more, so MinHash bands propose further
pairs. Every pair is checked exactly, so nothing below the measure is linked. A pair at the measure shares none
of the bands with a chance of 3 in a million; closer ones less.

A crowd of near copies is not checked pair by pair. Each text is checked with its smallest partner first, then with the smallest
and largest of its other bands where they are not joined yet. Texts that a band still holds in different groups are settled by a
prefix index: a text's shingles are put in order, those in the fewest of these texts first, and two near copies must
meet at a shingle so early in both orders that enough of each is left to share. Shingles of one text only take places, but are not
indexed, so texts of one template, whose rarest shingles are their own, meet nowhere. Where so many meet that their pairs are
out of proportion, one of them stands for all in a few rounds, and at last every two that meet and are in different groups are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmill.functions.once import computed_once
from boxmill.llm import simhash
from boxmill.llm.components import connected_components
from boxmill.llm.text import KEY, WORD, extended, key_columns, utf8, words
from boxmill.session import write_table

SHINGLE_WORDS = 5
# Shared shingles of all shingles, as a fraction.
SHARED, ALL = 4, 5

BANDS, BAND_ROWS = 32, 5
SEED = 42
# Shingles multiplied at once.
AT_ONCE = 1024

# Rounds in which one text stands for all that meet at a shingle; what they leave open is checked completely.
TURNS = 4
# Meetings per entry of the index up to which everything is checked at once, without such rounds.
PAIRS_PER_ENTRY = 16

# Bits of one bitmap, bits for each listed key, and the most bitmaps (16 MB).
MAP_BITS, MAP_SHARE, MOST_MAPS = 1 << 15, 16, 1 << 12

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingles(text: bytes | None) -> list[bytes]:
    """The shingles of a UTF-8 text in order, repeats included; a shorter text is one shingle, no words give none."""
    items = words((text or b"").lower())
    if not items:
        return []
    width = min(SHINGLE_WORDS, len(items))
    return [b" ".join(items[k : k + width]) for k in range(len(items) - width + 1)]


def bands(text: bytes | None) -> list[int]:
    """A signed 64-bit key per band; none without words."""
    listed = shingles(text)
    if not listed:
        return []
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in listed], np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, (hashes[k : k + AT_ONCE] * _FACTORS + _SHIFTS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), number) for number, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def text_node(text: Column) -> Column:
    """The node of a text: its 128-bit digest. Texts without a word, null ones too, are one node."""
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    return F.when(text.rlike(WORD), digest(text)).otherwise(digest(F.lit("")))


def signatures(documents: DataFrame) -> DataFrame:
    """``doc_id, node, keys, fingerprint``: one row of any document that has the text, for each text."""
    rows_in = documents.select("doc_id", "text", text_node(F.col("text")).alias("node"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            keys = pa.array([bands(t) for t in texts], pa.list_(pa.int64()))
            prints = pa.array(np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64))
            columns = [batch.column("doc_id"), batch.column("node"), keys, prints]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "keys", "fingerprint"])

    found = rows_in.mapInArrow(rows, extended(rows_in.select("doc_id", "node").schema, {"keys": "array<long>", "fingerprint": "long"}))
    return found.dropDuplicates(["node"])


def simhash_pairs(signed: DataFrame) -> DataFrame:
    """``a, b``, smaller node first: what operator 4 links. Each text with the smallest of its fingerprint, and these along the links."""
    ends = signed.groupBy("fingerprint").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("texts"))
    # Written out, so that both sides of the joins are dealt anew and Spark can split a hot fingerprint.
    ends = write_table(ends, "fingerprints")
    equal = signed.join(ends.where("texts > 1"), "fingerprint").select(F.col("low").alias("a"), F.col("node").alias("b"))
    linked = write_table(simhash.links(ends.select("fingerprint")), "simhash-links")
    low = lambda end: ends.select(F.col("fingerprint").alias(end), F.col("low").alias(f"low_{end}"))
    across = linked.join(low("a"), "a").join(low("b"), "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    return equal.where("a <> b").unionByName(across).distinct()


def candidates(shared: DataFrame) -> DataFrame:
    """``a, b``: each text with the smallest and the largest of every band it shares, smaller node first."""
    met = shared.select("node", F.explode(F.array("low", "high")).alias("end"))
    return met.where("node <> end").select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def maybe_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows whose key is in the written table ``listed``, and few others, without moving any row.

    Tasks look into bitmaps over the listed keys: 4 KB each, at most ``MOST_MAPS`` of them, so their broadcast is bounded.
    """
    wanted = MAP_SHARE * listed.count() / MAP_BITS
    maps = 1
    while maps < min(wanted, MOST_MAPS):
        maps *= 2
    place = F.pmod(F.xxhash64(*KEY), F.lit(maps * MAP_BITS)) + 1
    number, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    found = listed.groupBy(number.alias("map_")).agg(F.bitmap_construct_agg(bit).alias("bits_"))
    octet = F.conv(F.hex(F.substring("bits_", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = rows.withColumn("map_", number).join(F.broadcast(found), "map_").where(F.getbit(octet, bit % 8) == 1)
    # The optimiser would move a semi join on the key below this one, and with it all rows.
    return computed_once(there, *KEY).select(*rows.columns)


def shingle_sets(documents: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, shingles`` of the given nodes, written: the 64-bit hashes of the different shingles of each text."""
    # One document stands for each text: its key spreads out where a text is repeated over many documents.
    owners = signed.select("doc_id", "node").join(nodes, "node").select(*key_columns("doc_id", "node"))
    node = text_node(F.col("text"))
    keyed = documents.select(node.alias("node"), "text", *key_columns("doc_id", node))
    owners = write_table(owners, "owners")
    # Most texts have no partner: they are left where they are.
    bodies = maybe_listed(keyed, owners).join(owners, KEY, "left_semi").dropDuplicates(KEY).select("node", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(t)], np.uint64)).view(np.int64) for t in utf8(batch.column("text"))]
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "shingles"])

    found = bodies.mapInArrow(rows, extended(bodies.select("node").schema, {"size": "int", "shingles": "array<long>"}))
    return write_table(found, "shingles")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are near copies. Both inputs are written tables, so that Spark can split a hub."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(right, "b").join(left, "a").withColumn("shared", F.size(F.array_intersect("left", "right")))
    return both.where(ALL * F.col("shared") >= SHARED * (F.size("left") + F.size("right") - F.col("shared"))).select("a", "b")


def _ceiling(part: Column, whole: int) -> Column:
    return F.floor((part + (whole - 1)) / whole).cast("int")


def index_entries(sets: DataFrame) -> DataFrame:
    """``token, node, size, place``, written: the early shingles of the given sets that another of them holds as well.

    ``place`` counts from 0 in the order of the text's shingles by how many of the sets hold them.
    """
    tokens = sets.select("node", "size", F.explode("shingles").alias("token"))
    holders = write_table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "holders")
    own = Window.partitionBy("node")
    held = tokens.join(holders, "token").withColumns(
        {"rank": F.row_number().over(own.orderBy("holders", "token")), "held": F.count(F.lit(1)).over(own)}
    )
    held = held.withColumn("place", F.col("size") - F.col("held") + F.col("rank") - 1)
    # Of its own size, a text shares at least this much with any near copy.
    early = held.where(F.col("place") <= F.col("size") - _ceiling(SHARED * F.col("size"), ALL))
    return write_table(early.select("token", "node", "size", "place"), "entries")


def grouped(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries with the ``root`` of their node's group."""
    return entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def meeting(entries: DataFrame, others: DataFrame) -> DataFrame:
    """``a, b``, written: nodes of different groups that meet at a token with enough left on both sides. ``others`` has columns ``other_*``."""
    needed = _ceiling(SHARED * (F.col("size") + F.col("other_size")), SHARED + ALL)
    enough = (F.col("size") - F.col("place") >= needed) & (F.col("other_size") - F.col("other_place") >= needed)
    met = entries.join(others, "token").where((F.col("root") != F.col("other_root")) & enough)
    return write_table(met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct(), "meeting")


OTHER = ("node", "size", "place", "root")


def representatives(entries: DataFrame, turn: int) -> DataFrame:
    """One entry, drawn by hash, for each token whose entries are in several groups."""
    drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("draw"), *OTHER)).alias("one")
    found = entries.groupBy("token").agg(drawn, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return write_table(found.select("token", *(F.col(f"one.{c}").alias(f"other_{c}") for c in OTHER)), "representatives")


def few_pairs(entries: DataFrame) -> bool:
    """Whether all that ``outsiders`` lets meet is in proportion to the entries, so that nothing has to stand for others."""
    counts = entries.groupBy("token", "root").agg(F.count(F.lit(1)).cast("double").alias("own"))
    per = counts.groupBy("token").agg(F.sum("own").alias("n"), F.max("own").alias("largest"))
    total = per.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - F.col("largest"))), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))
    found = total.first()
    return found["pairs"] <= PAIRS_PER_ENTRY * found["n"]


def outsiders(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All entries of tokens with several groups, and those outside their token's largest group: of two groups one is outside."""
    counts = entries.groupBy("token", "root").count()
    largest = counts.groupBy("token").agg(F.max_by("root", "count").alias("largest"), F.count(F.lit(1)).alias("groups"))
    mixed = write_table(entries.join(write_table(largest.where("groups > 1").drop("groups"), "largest"), "token"), "mixed")
    outside = mixed.where("root <> largest").select("token", *(F.col(c).alias(f"other_{c}") for c in OTHER))
    return mixed, write_table(outside, "outside")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The groups after some more links."""
    return write_table(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "roots")


def groups(documents: DataFrame) -> DataFrame:
    """``node, root`` for every text that is not the smallest of its group of near copies."""
    signed = write_table(signatures(documents), "signatures")
    members = signed.select("node", F.explode("keys").alias("key"))
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    # Written out, so that both sides of a join are dealt anew and Spark can split a hot band.
    ends = write_table(ends, "bands")
    # Few of a text's bands are shared: the others move once, not in each step that reads the shared ones.
    shared = write_table(members.join(ends, "key"), "shared")
    pairs = write_table(candidates(shared), "candidates")
    close = write_table(simhash_pairs(signed), "simhash-pairs")
    # Every text with a common band or a fingerprint nearby is in one of these pairs.
    nodes = pairs.unionByName(close).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shingle_sets(documents, signed, nodes)
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = write_table(nearest.unionByName(close).distinct(), "first")
    near = write_table(checked(first, sets), "near")
    above = near.groupBy("b").agg(F.min("a").alias("up"))
    up = lambda end: above.select(F.col("b").alias(end), F.col("up").alias(f"up_{end}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(up("a"), "a", "left").join(up("b"), "b", "left")
    rest = rest.where(F.coalesce("up_a", "a") != F.coalesce("up_b", "b")).select("a", "b")
    found = near.unionByName(checked(write_table(rest, "rest"), sets))
    roots = write_table(connected_components(found), "roots")
    # What bands hold in different groups.
    met = write_table(grouped(shared.select("key", "node"), roots).select("key", "node", "root"), "met")
    several = met.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("key")
    unsettled = met.join(write_table(several, "several"), "key", "left_semi").select("node").distinct()
    # All that is left to check is between these texts.
    sets = write_table(sets.join(write_table(unsettled, "unsettled"), "node", "left_semi"), "unsettled-sets")
    entries = index_entries(sets)
    here = write_table(grouped(entries, roots), "grouped")
    for turn in range(TURNS):
        if few_pairs(here):
            break
        links = write_table(checked(meeting(here, representatives(here, turn)), sets), "links")
        if links.isEmpty():
            break
        roots = merged(roots, links)
        here = write_table(grouped(entries, roots), "grouped")
    mixed, outside = outsiders(here)
    return merged(roots, checked(meeting(mixed, outside), sets))


def without_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies: the smallest id (nulls last), then the smallest text hash; of equal rows any one.

    Near copies of near copies are one group. Texts without a word, null ones too, are one group. A very long text is compared as a
    whole. All columns of ``documents`` stay, whatever their names. An empty table stays empty.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    roots = write_table(groups(documents), "roots")
    found = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), text_node(F.col("text")).alias("node"))
    grouped = found.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    best = grouped.agg(F.min(order).alias("best")).select(*key_columns("best.doc_id", "best.text_hash"))
    keyed = documents.select(F.struct("*").alias("row"), *key_columns("doc_id", F.xxhash64("text")))
    return keyed.join(best, KEY, "left_semi").dropDuplicates(KEY).select("row.*")
