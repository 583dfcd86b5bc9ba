"""Class vocabularies and label names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The four signal classes; the position is the class id.
CLASS_NAMES = ("red", "yellow", "green", "off")

# Spellings with a known class.
LABEL_SPELLINGS = {
    "red": 0,
    "yellow": 1,
    "green": 2,
    "off": 3,
    "Red": 0,
    "Yellow": 1,
    "Green": 2,
    "Off": 3,
    "RedLeft": 0,
    "RedRight": 0,
    "RedStraight": 0,
    "RedStraightLeft": 0,
    "RedStraightRight": 0,
    "YellowLeft": 1,
    "YellowRight": 1,
    "YellowStraight": 1,
    "YellowStraightLeft": 1,
    "YellowStraightRight": 1,
    "GreenLeft": 2,
    "GreenRight": 2,
    "GreenStraight": 2,
    "GreenStraightLeft": 2,
    "GreenStraightRight": 2,
}

# Names of the detector's classes by id. Names repeat, so a name is not a key.
DETECTOR_CLASSES = (
    "tlr", "tly", "tlg", "tlra", "tlya", "tlga", "tsra", "tsya", "tsga",
    "trra", "trya", "trga", "tura", "tuya", "tuga", "tln", "tlr", "tly", "tlg",
    "tlra", "tlya", "tlga", "tsra", "tsya", "tsga", "trra", "trya", "trga",
    "tura", "tuya", "tuga", "tln",
    "117", "118", "119", "120", "121", "122", "123", "124", "125", "126",
    "127", "128", "129", "130", "131", "132", "133", "134", "135", "136",
    "137", "138", "139", "140", "141",
    "tnr", "tny", "tng", "tcr", "tcg", "tcn",
    "tllv", "tllvr", "tllvy", "tllvg", "tlrv", "tlrvr", "tlrvy", "tlrvg",
    "tlbv", "tclv", "tclvr", "tclvg", "tcrv", "tcrvr", "tcrvg", "tcbv",
)

# The ids that a reduced vocabulary keeps, renumbered from 0.
KEPT_IDS = tuple(range(16, 57))


def class_of_label(
    label: Column, spellings: Mapping[str, int] = LABEL_SPELLINGS, names: Sequence[str] = CLASS_NAMES
) -> Column:
    """Class id of a label: a known spelling, else the first class name contained in it, else null."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(spellings.items())])
    low = F.lower(label)
    contained = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(names))):
        contained = F.when(low.contains(name), F.lit(i)).otherwise(contained)
    return F.coalesce(F.try_element_at(known, label), contained)


def class_name(cls: Column, names: Sequence[str] = DETECTOR_CLASSES) -> Column:
    """Name of a class id; an id outside the vocabulary becomes its text."""
    known = F.array(*[F.lit(n) for n in names])
    inside = (cls >= 0) & (cls < len(names))
    return F.when(inside, F.get(known, cls)).otherwise(cls.cast("string"))


def reduced_vocabulary(
    spark: SparkSession, names: Sequence[str] = DETECTOR_CLASSES, kept: Sequence[int] = KEPT_IDS
) -> DataFrame:
    """``cls, old_cls, name``: kept ids renumbered from 0, the other slots blank. Only names move."""
    rows = [(i, old, names[old]) for i, old in enumerate(kept)]
    rows += [(i, None, "") for i in range(len(kept), len(names))]
    return spark.createDataFrame(rows, "cls int, old_cls int, name string")


def reduced_name(cls: Column, names: Sequence[str] = DETECTOR_CLASSES, kept: Sequence[int] = KEPT_IDS) -> Column:
    """Name of a class id in the reduced vocabulary."""
    shifted = [names[i] for i in kept] + [""] * (len(names) - len(kept))
    return class_name(cls, shifted)


def vocabulary(spark: SparkSession, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """``cls, name`` of a vocabulary."""
    return spark.createDataFrame(list(enumerate(names)), "cls int, name string")


def class_distribution(boxes: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Per split: every class of the vocabulary with its count and percentage, also at 0."""
    counts = boxes.groupBy("split", "cls").agg(F.count(F.lit(1)).alias("n"))
    by_class = counts.groupBy("split").agg(
        *[F.coalesce(F.sum(F.when(F.col("cls") == i, F.col("n"))), F.lit(0)).alias(f"n_{i}") for i in range(len(names))],
        F.sum("n").alias("total"),
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("cls"), F.lit(n).alias("name"), F.col(f"n_{i}").alias("n")) for i, n in enumerate(names)
    ])
    return by_class.select("split", "total", F.inline(rows)).select(
        "split", "cls", "name", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(0.0).alias("percentage")
    )
