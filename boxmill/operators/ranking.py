"""Ranks and order statistics that stay distributed when one group holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmill.session import small_table, write_table

# Rows of one group that a single task may sort.
TASK_ROWS = 200_000

Keys = Sequence[str]


def join_keys(left: DataFrame, right: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """Join on keys of the same names, where a null key is a key like any other; the columns of ``left``, then the rest of ``right``."""
    named = right.select(*(F.col(k).alias(f"right_{n}_") for n, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(Column.__and__, [left[k].eqNullSafe(named[f"right_{n}_"]) for n, k in enumerate(keys)])
    return left.join(named, same, how).drop(*(f"right_{n}_" for n in range(len(keys))))


def group_sizes(df: DataFrame, keys: Keys, limit: int) -> tuple[DataFrame | None, bool]:
    """Keys of the groups with more than ``limit`` rows (None when there is none), and whether there are any others."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    # The others make one row, so one job tells both.
    is_large, names = F.col("group_rows") > limit, [f"key_{n}_" for n in range(len(keys))]
    listed = [F.when(is_large, F.col(k)).alias(name) for k, name in zip(keys, names)]
    table, n = small_table(counts.groupBy(is_large.alias("large_"), *listed).agg(F.max("group_rows").alias("group_rows")), "large-groups")
    others = n != 0 and not table.where("NOT large_").isEmpty()
    if n == int(others):
        return None, others
    large = table.where("large_").select(*(F.col(name).alias(k) for k, name in zip(keys, names)), "group_rows")
    return large if n is None else F.broadcast(large), others


def large_groups(df: DataFrame, keys: Keys, limit: int) -> DataFrame | None:
    """Keys of the groups with more than ``limit`` rows, or None when there is none."""
    return group_sizes(df, keys, limit)[0]


def split_large(df: DataFrame, keys: Keys, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of groups above ``limit`` (None when there are none)."""
    large, others = group_sizes(df, keys, limit)
    if large is None:
        return df, None
    if not others:
        # The input is not computed again to find no rows.
        return df.where(F.lit(False)), df
    listed = large.select(*keys)
    return join_keys(df, listed, keys, "left_anti"), join_keys(df, listed, keys, "left_semi")


def sorted_chunks(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """Rows of ``df`` in one global order (keys, then ``order``), range-partitioned and written.

    Adds ``chunk`` (partition number, ascending in the global order) and ``chunk_row`` (row number in the partition), from
    which any running total can be put together: a total per chunk, plus work inside a chunk.
    """
    by = [F.col(k) for k in keys] + list(order)
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # The number counts rows within the partition, which is in order; both are written out and so never change.
    place = F.monotonically_increasing_id()
    numbered = ranged.select("*", F.spark_partition_id().cast("long").alias("chunk"), place.bitwiseAND((1 << 33) - 1).alias("chunk_row"))
    return write_table(numbered, "sorted")


def chunk_totals(chunks: DataFrame, keys: Keys, *totals: Column) -> DataFrame:
    """One row per chunk and key: row count, first row, and the given totals.

    As the rows are sorted by key this has about one row per file and one per key.
    """
    return chunks.groupBy("chunk", *keys).agg(
        F.count(F.lit(1)).alias("chunk_rows"), F.min("chunk_row").alias("first_row"), *totals
    )


def earlier_chunks(keys: Keys) -> Window:
    """Window over ``chunk_totals``: the chunks of the same key that come before this one."""
    return Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def row_number_within(
    df: DataFrame, keys: Keys, order: Sequence[Column], name: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``row_number()`` per group. Groups above ``task_rows`` are range-sorted over many tasks instead of one."""
    small, large = split_large(df, keys, task_rows)
    ranked = small.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if large is None:
        return ranked
    chunks = sorted_chunks(large, keys, order)
    before = F.coalesce(F.sum("chunk_rows").over(earlier_chunks(keys)), F.lit(0))
    starts, _ = small_table(
        chunk_totals(chunks, keys).select("chunk", *keys, (before - F.col("first_row")).alias("shift")), "chunk-starts"
    )
    placed = join_keys(chunks, starts, ["chunk", *keys]).withColumn(
        name, (F.col("chunk_row") + F.col("shift") + 1).cast("int")
    )
    return ranked.unionByName(placed.select(ranked.columns))


def percentile_within(
    df: DataFrame, keys: Keys, value: str, fraction: float, name: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Exact percentile per group with linear interpolation between neighbours; null values do not count.

    By selection: the two wanted places are looked for in the sorted values of a group. Where a group has more than
    ``task_rows`` of them, they are first counted in buckets of value, and only the bucket with the wanted places is kept, again
    and again. A null group is a group like any other, NaN comes after all numbers, and a group without values has a null percentile.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("value_"))
    number, place = _place(F.col("n_"), fraction)
    large = large_groups(rows.where("value_ IS NOT NULL"), keys, task_rows)
    small = rows if large is None else join_keys(rows, large.select(*keys), keys, "left_anti")
    sorted_values = F.sort_array(F.collect_list("value_"))
    # Ordinary groups and what the selection leaves of the others end alike: in one sorted array.
    arrays = small.groupBy(*keys).agg(sorted_values.alias("values_"), F.count("value_").alias("n_"))
    arrays = arrays.select(*keys, "values_", number.alias("low_"), (place - number).alias("weight_"))
    found = []
    if large is not None:
        picked, left = _select(join_keys(rows.where("value_ IS NOT NULL"), large.select(*keys), keys, "left_semi"), keys, fraction, task_rows)
        found = [p.select(*keys, F.array("a_", "b_").alias("values_"), F.lit(0).cast("long").alias("low_"), "weight_") for p in picked]
        ends = left.groupBy(*keys, "low_", "weight_").agg(sorted_values.alias("values_"))
        found.append(ends.select(*keys, "values_", "low_", "weight_"))
    joined = reduce(DataFrame.unionByName, found, arrays)
    at = lambda k: F.get("values_", k.cast("int"))
    low, weight = F.col("low_"), F.col("weight_")
    between = F.when(weight > 0, (1 - weight) * at(low) + weight * at(low + 1)).otherwise(at(low))
    return joined.select(*keys, between.alias(name))


def _place(n: Column, fraction: float) -> tuple[Column, Column]:
    """The place of a percentile among ``n`` sorted values from 0, rounded down and as it is."""
    place = (n - 1) * F.lit(fraction)
    return F.greatest(F.floor(place), F.lit(0).cast("long")), F.greatest(place, F.lit(0.0))


# Buckets of value per round of a selection.
BUCKETS = 1024


def _half(*values: Column) -> list[Column]:
    """Half of each value: differences of these never overflow."""
    return [v / 2 for v in values]


def _magnitude(*values: Column) -> list[Column]:
    """Ascending like the values, by powers of two on both sides of 0."""
    return [F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100)) for v in values]


def _select(rows: DataFrame, keys: Keys, fraction: float, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """The two wanted values ``a_, b_`` with their ``weight_`` for groups that are settled by bucket totals, and for the others the rows of one bucket.

    Each round counts rows per bucket between a group's smallest and largest value. The neighbouring places either fall into two buckets,
    whose largest and smallest values they are, or into one, which replaces the group. In buckets of equal width the smallest
    and the largest value never share one, so the rounds end.
    """
    rows = write_table(rows, "selection")
    number, place = _place(F.col("n_"), fraction)
    finite = F.when(F.abs("value_") < float("inf"), F.col("value_"))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.min(finite).alias("from_"), F.max(finite).alias("to_"))
    groups = groups.select(*keys, "from_", "to_", number.alias("low_"), (place - number).alias("weight_"))
    picked: list[DataFrame] = []
    done: list[DataFrame] = []
    turn = 0
    while True:
        state, _ = small_table(groups, "selection-state")
        joined = join_keys(rows, state, keys)
        # Buckets of magnitude and buckets of equal width take turns, as values may span many powers of ten.
        scale = (_magnitude if turn % 2 == 0 else _half)(F.col("value_"), F.col("from_"), F.col("to_"))
        turn += 1
        share = F.when(scale[2] == scale[1], 0.0).otherwise((scale[0] - scale[1]) / (scale[2] - scale[1]))
        inside = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        bucket = (
            F.when(F.isnan("value_"), BUCKETS + 1).when(F.col("value_") == float("inf"), BUCKETS).when(F.col("value_") == float("-inf"), -1)
            .when(F.col("from_") == F.col("to_"), 0).otherwise(inside)
        )
        joined = joined.withColumn("bucket_", bucket.cast("int"))
        totals = joined.groupBy(*keys, "bucket_", "low_", "weight_").agg(
            F.count(F.lit(1)).alias("rows_"), F.min("value_").alias("least_"), F.max("value_").alias("most_")
        )
        in_order = Window.partitionBy(*keys).orderBy("bucket_")
        totals = totals.withColumns(
            {
                "before_": F.coalesce(F.sum("rows_").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "next_": F.lead("least_").over(in_order),
            }
        )
        here = (F.col("low_") >= F.col("before_")) & (F.col("low_") < F.col("before_") + F.col("rows_"))
        totals = write_table(totals.where(here), "selection-buckets")
        # The upper place is the next bucket's smallest value, or in this one as well.
        last = F.col("low_") + 1 == F.col("before_") + F.col("rows_")
        settled = (F.col("least_").eqNullSafe(F.col("most_"))) | (last & ((F.col("weight_") == 0) | F.col("next_").isNotNull()))
        upper = F.when(last & F.col("next_").isNotNull(), F.col("next_")).otherwise(F.col("most_"))
        picked.append(totals.where(settled).select(*keys, F.col("most_").alias("a_"), upper.alias("b_"), "weight_"))
        further = totals.where(~settled).select(
            *keys, "bucket_", "rows_", F.col("least_").alias("from_"), F.col("most_").alias("to_"),
            (F.col("low_") - F.col("before_")).alias("low_"), "weight_",
        )
        kept = join_keys(joined.drop("low_", "weight_", "from_", "to_"), further, [*keys, "bucket_"]).drop("bucket_")
        kept = write_table(kept, "selection")
        done.append(kept.where(F.col("rows_") <= limit).select(*keys, "value_", "low_", "weight_"))
        rows = kept.where(F.col("rows_") > limit).select(*keys, "value_")
        groups = further.where(F.col("rows_") > limit).select(*keys, "from_", "to_", "low_", "weight_")
        if groups.isEmpty():
            return picked, reduce(DataFrame.unionByName, done)


def top_rows(df: DataFrame, keys: Keys, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group. Spark cuts each group to ``n`` rows before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)
