"""The one order of scores: descending, then NaN, then null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_order(conf: Column) -> list[Column]:
    """Two values that sort ascending: NaN scores come after all numbers, null ones last."""
    conf = conf.cast("double")
    unscored = F.when(conf.isNull(), 2).when(F.isnan(conf), 1).otherwise(0)
    return [unscored, F.when(unscored == 0, -conf).otherwise(0.0)]
