"""Random splits and samples that are reproducible: the order is the md5 of a seed and the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmill.operators.ranking import join_keys

# Leading hex digits of the hash that cut the order into buckets: 65,536 buckets per stratum.
BUCKET_DIGITS = 4


def shuffle_key(seed: int | str, key: Column) -> Column:
    """The place of a row in the shuffled order; a null key is a key like any other, apart from the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("\0"))))


def shuffled_rank(df: DataFrame, key: Column, seed: int | str, strata: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (1-based) and ``total``: position in the shuffled order, within the strata if given.

    ``key`` must tell rows apart. The rank is the size of the earlier hash buckets plus the position inside the bucket. So
    no task sorts a whole stratum, though there may be only one.
    """
    strata = list(strata)
    hashed = df.withColumn("shuffle_", shuffle_key(seed, key)).withColumn(
        "bucket_", F.substring("shuffle_", 1, BUCKET_DIGITS)
    )
    part = Window.partitionBy(*(strata or [F.lit(0)]))
    before = part.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(*strata, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    offsets = sizes.select(
        *strata, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"),
        F.sum("n_").over(part).alias("total"),
    )
    inside = Window.partitionBy(*strata, "bucket_").orderBy("shuffle_")
    return (
        join_keys(hashed.withColumn("inside_", F.row_number().over(inside)), offsets, [*strata, "bucket_"])
        .withColumn("rank", F.col("before_") + F.col("inside_"))
        .drop("shuffle_", "bucket_", "inside_", "before_")
    )


def train_val_split(df: DataFrame, key: Column, seed: int | str = 0, train_share: float = 0.8) -> DataFrame:
    """Adds ``subset``: the first ``int(share * n)`` of the shuffled rows are train, the rest val."""
    ranked = shuffled_rank(df, key, seed)
    is_train = F.col("rank") <= F.floor(F.col("total") * train_share)
    return ranked.withColumn("subset", F.when(is_train, "train").otherwise("val")).drop("rank", "total")


def stratified_split(
    df: DataFrame, key: Column, label: str = "label", seed: int | str = 42, test_share: float = 0.2
) -> DataFrame:
    """Adds ``subset`` with the same test share in every label. Tiles of one image can fall on both sides."""
    ranked = shuffled_rank(df, key, seed, [label])
    is_test = F.col("rank") <= F.ceil(F.col("total") * test_share)
    return ranked.withColumn("subset", F.when(is_test, "test").otherwise("train")).drop("rank", "total")


def grouped_split(df: DataFrame, group: str, seed: int | str = 42, test_share: float = 0.2) -> DataFrame:
    """Adds ``subset`` so that all rows of a group, such as the tiles of an image, stay on one side."""
    ranked = shuffled_rank(df.select(group).distinct(), F.col(group), seed)
    is_test = F.col("rank") <= F.ceil(F.col("total") * test_share)
    sides = ranked.select(group, F.when(is_test, "test").otherwise("train").alias("subset"))
    return join_keys(df, sides, [group])


def random_rows(df: DataFrame, key: Column, n: int = 1, seed: int | str = 0) -> DataFrame:
    """A reproducible random sample of ``n`` rows."""
    return df.orderBy(shuffle_key(seed, key)).limit(n)


def first_images(images: DataFrame, n: int) -> DataFrame:
    """The first ``n`` images in listing order (split, extension, path); 0 keeps all."""
    if not n:
        return images
    return images.orderBy("split_rank", "ext_rank", "path").limit(n)
