"""Small text helpers that several operators share. They run inside tasks, on one text at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

SYMBOLS = "#*$%&|<>"


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def words(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text. ``bytes.split`` splits at exactly the six blanks."""
    return raw.split()


def word_ids(items: list[bytes]) -> np.ndarray:
    """Numbers the different words in order of appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in items), np.int64, len(items))


def repeated_window_words(ids: np.ndarray, width: int = 8) -> int:
    """How many words lie in a window of ``width`` words that the text holds twice or more, first ones included.

    Windows are named exactly, by doubling: the names of two neighbouring halves give the name of the whole.
    ``width`` is a power of two.
    """
    names, step = ids, 1
    while step < width:
        if len(names) - step < 2:
            return 0
        pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    repeated = np.bincount(names)[names] > 1
    if not repeated.any():
        return 0
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without its own columns of these names (in any case), so that new ones may take them."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def key_columns(*columns: Column | str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's identity: never null, so joins and grouping on them share one shuffle."""
    return [F.xxhash64(*columns).alias("key_a"), F.xxhash64(F.lit(1), *columns).alias("key_b")]


KEY = ["key_a", "key_b"]


def extended(schema: T.StructType, added: dict[str, str]) -> T.StructType:
    """A new schema: the fields of ``schema``, then ``added`` (names and SQL types)."""
    return T.StructType([*schema.fields, *(T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in added.items())])
