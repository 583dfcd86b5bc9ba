"""Mixing sources to target weights by systematic sampling (operator 7).

Within a source, each document expects ``target / source size`` copies. Documents are put in order of size, expected
copies are summed up along that order, one random offset per source is added, and a document is emitted once for
each whole number that its stretch crosses. The order by size keeps the words taken within about one document's
size of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxmill.llm.text import KEY, WORD, key_columns
from boxmill.session import write_table

# Weights by the place of a source in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: shares of the total by weight, none above ``most`` times its size.

    Sources take the weights in code point order, null last. Sources that their weight would lift above the limit stop
    there, and the rest is shared among the others by weight until none is above: sorted by limit per weight, this is
    the first place from which the remaining level fits all that follow. Works on one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    by_level = everything.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / F.sum("weight").over(onward),
    )
    fits = F.col("level") <= F.col("limit") / F.col("weight")
    # The level rises until it fits and falls from then on, so the first one that fits is the largest that fits.
    rows = rows.withColumn("common", F.max(F.when(fits, F.col("level"))).over(everything))
    target = F.least(F.col("limit").cast("double"), F.col("common") * F.col("weight"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def offset(seed: int = SEED):
    """The random offset of a source, in [0, 1): the same for the same source and seed."""
    name = F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("\0")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = SEED
) -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, copies`` per row of ``documents``.

    ``size`` counts words; a null text has none. A null source is a source. Rows of equal id, source and size follow each
    other by text hash, so reruns agree whatever the partitioning. Sources without words expect no copies. An empty
    table gives an empty result.

    Places within a source come from a range sort over all rows: the sorted parts are written once, the parts'
    row counts per source give where each part starts, so no source is ever in one task.
    """
    sized = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    order = ["size", "doc_id", "text_hash"]
    ranged = sized.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id())
    ranged = write_table(ranged, "mixing")
    counts = ranged.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, most).withColumn("offset", offset(seed))
    starts = starts.alias("s").join(plan.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("s.source").alias("of"), F.col("s.part").alias("in"), "start", "source_size", "target", "offset")
    rank = F.row_number().over(Window.partitionBy("part", "source").orderBy(*order))
    here = ranged.withColumn("rank", rank)
    joined = here.join(starts, here["source"].eqNullSafe(starts["of"]) & (here["part"] == starts["in"]))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("start") + F.col("rank")
    crossed = F.floor(ratio * place + F.col("offset")) - F.floor(ratio * (place - 1) + F.col("offset"))
    return joined.select("doc_id", "text_hash", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mixed(documents: DataFrame, **settings) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it.

    Rows that agree in id, source and text are one document here: any of them stands for all and is repeated as
    often as they are taken together.
    """
    taken = copies(documents, **settings)
    taken = taken.groupBy(*key_columns("doc_id", "source", "text_hash")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    keyed = documents.select(
        F.struct("*").alias("row"), *key_columns("doc_id", F.col("source").cast("string"), F.xxhash64("text"))
    )
    joined = keyed.dropDuplicates(KEY).join(taken, KEY)
    # In two steps, so that very many equal rows never make one very long array.
    hundreds = joined.select("row", "copies", F.explode(F.sequence(F.lit(0), F.col("copies"), F.lit(100))).alias("first"))
    rest = F.least(F.lit(100), F.col("copies") - F.col("first"))
    return hundreds.where(rest > 0).select("row", F.explode(F.sequence(F.lit(1), rest))).select("row.*")
