"""Exact dedup by sorting whole contents (operator 12). DataFrame operations only.

Rows get a place in one order of contents: the head of the normalised text, a hash of the whole text, and a hash of the id,
which lets a group of copies spread over many ranges. Splitters sampled from all rows cut that order into ranges; each range
is sorted by its normalised texts, so that equal texts are neighbours, and neighbouring texts are compared in full. A group
that a splitter cuts is put together from its parts, again by comparing whole texts: one row per part, never all copies.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmill.session import write_table

# Code points of a text that its place starts with.
HEAD = 32

# Rows sampled for each range, and for all ranges together: this bounds what the driver sorts.
RANGE_SAMPLES = 64
MAX_SAMPLES = 500_000
SEED = 12

# Hex digits of the id's hash, the last part of a place.
TIE_DIGITS = 16


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def placed(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` (normalised) and ``place``; places compare like their heads, then by the hashes."""
    rows = documents.select("doc_id", normalised(F.col("text")).alias("text"))
    hashed = lambda c: F.lpad(F.hex(F.xxhash64(c)), TIE_DIGITS, "0")
    # The blank sorts before all hex digits, so a head that is the start of another one comes first.
    head = F.hex(F.encode(F.substring("text", 1, HEAD), "utf-8"))
    return rows.withColumn("place", F.concat(head, F.lit(" "), hashed("text"), hashed("doc_id")))


def content(place: Column) -> Column:
    """The part of a place that equal texts share."""
    return F.substring(place, F.lit(1), F.length(place) - TIE_DIGITS)


def splitters(documents: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` ascending places that cut the rows into ranges of about equal row counts."""
    rows = documents.count()
    wanted = min(ranges * RANGE_SAMPLES, MAX_SAMPLES)
    some = documents if rows <= wanted else documents.sample(fraction=wanted / rows, seed=SEED)
    found = sorted(r[0] for r in placed(some).select("place").collect())
    cuts = {found[k * len(found) // ranges] for k in range(1, ranges)} if found else set()
    return sorted(cuts)


def range_number(place: Column, cuts: Column, n: int) -> Column:
    """How many of the ``n`` ascending cuts are not above ``place``, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(cuts, at + step - 1) <= place), at + step).otherwise(at)
    )


def parts(documents: DataFrame, ranges: int) -> DataFrame:
    """One row per document, in ranges of the content order, with what its range knows of its group.

    ``range, part`` name the neighbours with an equal text, ``part_keep`` and ``part_rows`` are their largest id and their
    number, ``latest`` marks one row with the largest id. ``cut_text`` is the whole text, on the first row of a part that
    a splitter may have cut off from others.
    """
    found = splitters(documents, ranges)
    # One literal for all cuts: no hex digit and no blank is a comma.
    cuts = F.split(F.lit(",".join(found)), ",")
    rows = placed(documents).withColumn("range", range_number(F.col("place"), cuts, len(found)))
    at_cut = lambda k: F.coalesce(F.startswith(F.get(cuts, k), F.col("content")), F.lit(False))
    rows = rows.repartitionById(ranges, "range").withColumn("content", content(F.col("place")))
    in_order = Window.partitionBy("range").orderBy("content", "text", "doc_id")
    rows = rows.withColumns({"before": F.lag("text").over(in_order), "number": F.row_number().over(in_order)})
    starts = ~F.col("before").eqNullSafe(F.col("text"))
    rows = rows.select(
        "range", "number", "doc_id", starts.alias("starts"), F.sha2("text", 256).alias("text_sha256"),
        F.when(starts & (at_cut(F.col("range") - 1) | at_cut(F.col("range"))), F.col("text")).alias("cut_text"),
    )
    first = F.max(F.when(F.col("starts"), F.col("number"))).over(Window.partitionBy("range").orderBy("number"))
    rows = rows.withColumn("part", first)
    own = Window.partitionBy("range", "part")
    rows = rows.withColumns(
        {
            "part_keep": F.max("doc_id").over(own),
            "part_rows": F.count(F.lit(1)).over(own),
            # Ids ascend in a part, nulls first.
            "latest": F.col("number") == F.max("number").over(own),
        }
    )
    return rows.select("range", "part", "doc_id", "text_sha256", "cut_text", "part_keep", "part_rows", "latest")


def exact_groups(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, where rows with equal normalised texts are a group.

    The row with the largest id stays; of several such rows one, and of a group without ids one. Null texts are empty texts, and
    these are a group like any other. Very long texts are compared in full like short ones. Other columns are not read. An
    empty table gives an empty result. ``ranges`` is the session's number of shuffle partitions unless given; rows that agree in
    id and text share a range.
    """
    ranges = ranges or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = write_table(parts(documents, ranges), "content-parts")
    cut = rows.where("cut_text IS NOT NULL").groupBy("cut_text").agg(
        F.max("part_keep").alias("keep"), F.sum("part_rows").alias("rows"), F.collect_list(F.struct("range", "part")).alias("own")
    )
    # At most two parts for each splitter, unless hashes collide.
    whole = cut.where(F.size("own") > 1).select("keep", "rows", F.inline("own"))
    joined = rows.join(whole, ["range", "part"], "left")
    spread = F.col("rows").isNotNull()
    joined = joined.withColumn("keep_id", F.when(spread, F.col("keep")).otherwise(F.col("part_keep")))
    return joined.select(
        "doc_id",
        "keep_id",
        F.coalesce("rows", "part_rows").alias("group_size"),
        (F.col("latest") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
