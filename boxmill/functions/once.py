"""A stop for the optimiser: costly columns are computed once, however often later steps and filters use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows and columns, the named columns last and passed on as a generated row.

    A filter on a column is otherwise moved below it and computes it again, and with it all that it is made of.
    """
    return df.select(*(c for c in df.columns if c not in names), F.inline(F.array(F.struct(*names))))


def exploded(df: DataFrame, name: str, low: str, high: str, step: int = 1) -> DataFrame:
    """A row for each whole number ``name`` from the column ``low`` to the column ``high``, ``step`` apart; both are dropped.

    The ends are columns of their own, as generators are interpreted and so should have nothing to compute. A plain ``explode`` would
    infer a filter on the array, which is moved down and computes the ends again; a null end gives no row either way.
    """
    spread = df.select(*(c for c in df.columns if c not in (low, high)), F.explode_outer(F.sequence(low, high, F.lit(step))).alias(name))
    return spread.where(F.col(name).isNotNull())
