"""Image files and tile pixels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.functions import grids
from boxmill.functions.names import file_name, stem
from boxmill.operators.tiling import OVERLAP, TILE_SIZE
from boxmill.sources.files import list_files

SPLITS = ("train", "val", "test")

# The grey of the padding outside an image.
PAD_VALUE = 114

# Tiles of one image that leave a task as one batch.
TILES_AT_ONCE = 16

# Which extensions count as images; the order is the listing order.
EXTENSIONS = ("jpg", "jpeg", "png")


def list_images(
    paths: DataFrame, extensions: Sequence[str] = EXTENSIONS, ignore_case: bool = False, splits: Sequence[str] = SPLITS,
    images_last: bool = True,
) -> DataFrame:
    """Image files of a listing (column ``path``): ``path, split, file, stem, split_rank, ext_rank``.

    The layout is ``{split}/images/file`` or ``{split}/img/file`` or, with ``images_last=False``, ``images/{split}/file``. Order
    the result by ``split_rank, ext_rank, path`` for the listing order.
    """
    path = F.col("path")
    pattern = r"([^/]+)/(?:images|img)/[^/]+$" if images_last else r"images/([^/]+)/[^/]+$"
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    ext = F.lower(ext) if ignore_case else ext
    split = F.regexp_extract(path, pattern, 1)
    return (
        paths.select(path, split.alias("split"), file_name(path).alias("file"), stem(path).alias("stem"), ext.alias("ext"))
        .filter(F.col("split").isin(*splits) & F.col("ext").isin(*extensions))
        .withColumn("split_rank", F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split")))
        .withColumn("ext_rank", F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("ext")))
        .drop("ext")
    )


def gather_images(spark: SparkSession, root: str, **options) -> DataFrame:
    """``list_images`` of a dataset folder. Folders are listed by tasks, level by level; no content is read."""
    return list_images(list_files(spark, root).select("path"), **options)


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded images: ``path, height, width, nChannels, mode, data`` with row-wise BGR data.

    Files that cannot be decoded are dropped, or kept with ``width`` -1.
    """
    raw = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return raw.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.mode", "image.data")


def image_sizes(images: DataFrame) -> DataFrame:
    """``path, width, height`` with null sizes for unreadable images."""
    def known(c: str) -> Column:
        return F.when(F.col("width") > 0, F.col(c)).alias(c)

    return images.select("path", known("width"), known("height"))


def crop_tiles(images: DataFrame, tile: int = TILE_SIZE, overlap: float = OVERLAP, key: str = "path") -> DataFrame:
    """Tile pixels of a covering grid: ``key, tile_id, x, y, height, width, nChannels, data``.

    A tile that passes the right or bottom edge is padded with grey. Images stream through Arrow; tiles leave in groups of
    TILES_AT_ONCE, so a large image is never there twice.
    """
    source = images.withColumn("xs", grids.tile_starts(F.col("width"), tile, overlap)).withColumn(
        "ys", grids.tile_starts(F.col("height"), tile, overlap)
    )
    kind = images.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, tile_id int, x int, y int, height int, width int, nChannels int, data binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                every = [(int(x), int(y)) for y in row.ys for x in row.xs]
                for first in range(0, len(every), TILES_AT_ONCE):
                    spots = every[first : first + TILES_AT_ONCE]
                    yield pd.DataFrame({
                        key: [getattr(row, key)] * len(spots),
                        "tile_id": range(first, first + len(spots)),
                        "x": [x for x, _ in spots],
                        "y": [y for _, y in spots],
                        "height": tile,
                        "width": tile,
                        "nChannels": row.nChannels,
                        "data": [_padded(pixels[y : y + tile, x : x + tile], tile).tobytes() for x, y in spots],
                    })

    return source.select(key, "height", "width", "nChannels", "data", "xs", "ys").mapInPandas(cut, schema)


def _padded(part: np.ndarray, tile: int) -> np.ndarray:
    if part.shape[0] == tile and part.shape[1] == tile:
        return part
    full = np.full((tile, tile, part.shape[2]), PAD_VALUE, np.uint8)
    full[: part.shape[0], : part.shape[1]] = part
    return full


def write_by_split(df: DataFrame, path: str) -> None:
    """Replace a table, partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
