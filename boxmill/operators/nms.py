"""Greedy non-maximum suppression.

Detections: ``image_id, det_id, cls, x1, y1, x2, y2, conf`` plus any payload columns. All rows of an image have one
total order: ``conf`` descending, NaN and then null scores last, then ``tile_id`` (if there is one), ``det_id``, class,
corners, and at last the row's hash. A detection is kept unless its IoU with an already kept one (of the same class, or
of any class when ``agnostic``) is above the threshold; an IoU equal to the threshold survives. Boxes without
positive area or with coordinates that are not finite meet nothing and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmill.functions.cells import CELL, COARSEST, FINEST, NOWHERE, SLACK, centre_cell, centre_reach, grid_level, in_cells, level_of, partner_levels, placeable, reach
from boxmill.functions.geometry import CORNERS, corners, iou, overlaps
from boxmill.functions.once import computed_once
from boxmill.functions.scores import score_order
from boxmill.operators.ranking import split_large, top_rows
from boxmill.session import write_table

# Detections of one image that are walked through as one array. Larger images are cut to regions, with the same result.
ARRAY_ROWS = 1000

# The side of a region, in units of the largest boxes that are at home there.
REGION_SIDES = 4
# Cells of a region per side of its largest boxes, so that few rows are looked at that are too far away.
FINE = 8
# What a region says of a detection, from the rows it sees.
OPEN, KEPT, STRUCK = 0, 1, 2

IMAGE_KEYS = ("image_id",)


def _rank_values(df: DataFrame) -> list[Column]:
    """The place of a detection in its image, as values that sort ascending; equal only for equal rows."""
    ids = [F.col(c) for c in ("tile_id", "det_id") if c in df.columns]
    return [*score_order(F.col("conf")), *ids, F.col("cls"), *corners(), F.xxhash64(*df.columns)]


def _rank(df: DataFrame) -> Column:
    """``_rank_values`` as a struct."""
    return F.struct(*(v.alias(f"r{n}") for n, v in enumerate(_rank_values(df))))


def _packed(df: DataFrame, rest: list[str]) -> Column:
    """A detection as a struct that sorts by its place in the image: the fields of ``_rank``, then the other columns of ``rest``.

    ``first_`` is the first corner, and null for a box that meets nothing, so that a pair of boxes is settled by few terms; ``area_`` is the area.
    """
    ids = [c for c in ("tile_id", "det_id", "cls", *CORNERS) if c in rest]
    score = [v.alias(f"score_{n}_") for n, v in enumerate(score_order(F.col("conf")))]
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in CORNERS)
    meets = placeable(corners())
    last = [c for c in rest if c not in ids]
    first, area = F.when(meets, x1).alias("first_"), F.when(meets, (x2 - x1) * (y2 - y1)).alias("area_")
    return F.struct(*score, *ids, F.xxhash64(*df.columns).alias("hash_"), *last, first, area)


def _conflict(kept: Column, other: Column, threshold: float, agnostic: bool) -> Column:
    # Interpreted, from left to right: most pairs end at the first comparisons. Null corners end there, too.
    a, b = ([box["first_"], *(box[c].cast("double") for c in CORNERS[1:])] for box in (kept, other))
    shared = (F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * (F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    close = overlaps(a, b) & (shared / F.greatest(kept["area_"] + other["area_"] - shared, F.lit(1e-9)) > threshold)
    return close if agnostic else (kept["cls"] == other["cls"]) & close


def _greedy(candidates: Column, empty: Column, threshold: float, agnostic: bool, room: int | None) -> Column:
    """Walk through an ordered array of detections and collect the kept ones, at most ``room`` of them."""

    def step(kept: Column, det: Column) -> Column:
        drop = F.exists(kept, lambda k: _conflict(k, det, threshold, agnostic))
        if room:
            drop = (F.size(kept) >= room) | drop
        return F.when(drop, kept).otherwise(F.concat(kept, F.array(det)))

    return F.aggregate(candidates, empty, step)


def nms(
    detections: DataFrame,
    iou_threshold: float = 0.5,
    max_det: int | None = 300,
    agnostic: bool = False,
    keys: tuple[str, ...] = IMAGE_KEYS,
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """Kept detections per image, at most ``max_det`` of them (None or 0: no limit). Null keys make one image.

    The class-wise limit and the limit on the merged list coincide: the first ``max_det`` of the merged list hold
    at most ``max_det`` of any class. So one pass over the image in score order is enough.

    Ordinary images take one shuffle on the image key and one array per image. Images with more than
    ``array_rows`` detections are never collected as a whole; see ``_nms_in_regions``. Both give the same rows.
    """
    keys_ = list(keys)
    small, large = split_large(detections, keys_, array_rows)
    rest = [c for c in detections.columns if c not in keys_]
    # Packed before the rows are collected: what a collecting aggregate holds is interpreted row by row.
    packed = small.select(*keys_, _packed(detections, rest).alias("packed_"))
    empty = F.array().cast(f"array<{packed.schema['packed_'].dataType.simpleString()}>")
    kept = (
        packed.groupBy(*keys_)
        .agg(F.sort_array(F.collect_list("packed_")).alias("candidates"))
        .select(*keys_, F.explode(_greedy(F.col("candidates"), empty, iou_threshold, agnostic, max_det)).alias("kept"))
        .select(*[F.col(c) if c in keys_ else F.col("kept")[c].alias(c) for c in detections.columns])
    )
    if large is None:
        return kept
    return kept.unionByName(_nms_in_regions(large, iou_threshold, max_det, agnostic, keys_))


def _nms_in_regions(detections: DataFrame, threshold: float, max_det: int | None, agnostic: bool, keys: list[str]) -> DataFrame:
    """Exact NMS for images of any size, cut to regions with a border as wide as a suppression can reach.

    A detection is at home in one region of its size, and is seen by all regions where one that it can suppress, or that
    can suppress it, is at home. A region goes through what it sees from the best one down: it strikes out what a kept one
    suppresses, keeps its own ones that no other can suppress any more, and leaves open what depends on the fate of
    a detection of another region. Only what is open, and what was kept near it, takes another round. The best
    open detection is settled in each round, and chains of suppression seldom cross many borders.

    The rows themselves go through their home region and are stored when they are kept, so nothing is numbered, stored before or joined
    afterwards: on the disks are one shuffle, about as wide as the input, and what is kept. Equal rows need no number,
    as they share their home and all that sees them.
    """
    names, own = detections.columns, [*keys] if agnostic else [*keys, "cls"]
    # Corners enter levels, cells and ends many times, and may be computed ones.
    rows = computed_once(detections, *CORNERS).withColumn(KNOWN, F.lit(OPEN))
    lowest, highest = FINEST, COARSEST
    if not _few_levels(threshold):
        # Boxes of very different sizes meet. Then the grids end a few levels below the largest box, as large boxes would be seen by too many regions of finer ones.
        rows = write_table(rows, "nms-rows")
        highest = rows.where(placeable(_boxes())).agg(F.max(level_of(_boxes()))).first()[0] or FINEST
        lowest = max(FINEST, highest - OWN_LEVELS + 1)
    dealt, kept = _dealt(rows, names, own, threshold, lowest, highest), []
    while True:
        found = write_table(_walked(dealt.repartition(*own, *CELL), detections, own, threshold), "nms-fates")
        kept.append(found.where(F.col(KNOWN) == KEPT).select(*names))
        if found.where(F.col(KNOWN) == OPEN).isEmpty():
            break
        # Rows kept in earlier rounds have struck out what they can, and those of this round have done so at home.
        dealt = _dealt(found, names, own, threshold, lowest, highest).where(~F.col(HOME) | (F.col(KNOWN) == OPEN)).withColumns(_region(own))
        waiting = write_table(dealt.where(HOME).select(*REGION).distinct(), "nms-regions")
        dealt = dealt.join(waiting, list(REGION), "left_semi")
    chosen = reduce(DataFrame.unionByName, kept)
    if max_det:
        chosen = top_rows(chosen.withColumn("nms_rank", _rank(chosen)), keys, [F.col("nms_rank")], max_det, "nms_place")
    return chosen.select(*names)


REGION = ("nms_region_a", "nms_region_b")
# Whether a region is the home of a row, and what is known of it.
HOME, KNOWN = "nms_home", "nms_known"
# Corners as the regions compare them.
BOX = tuple(f"nms_{c}" for c in CORNERS)

# Up to so many levels of difference, boxes are at home on the grid of their own level.
OWN_LEVELS = 6


def _few_levels(threshold: float) -> bool:
    """Whether boxes that can suppress each other differ by few levels; a threshold below 1/64 lets boxes of very different sizes meet."""
    return threshold * (1 << OWN_LEVELS) >= 1


def _boxes() -> list[Column]:
    return [c.cast("double") for c in corners()]


def _region(own: list[str]) -> dict[str, Column]:
    """The key of a region as two numbers."""
    place = [*(F.col(c).isNull() for c in own), *own, *CELL]
    return {name: F.xxhash64(F.lit(n), *place) for n, name in enumerate(REGION)}


def _dealt(rows: DataFrame, names: list[str], own: list[str], threshold: float, lowest: int, highest: int) -> DataFrame:
    """A row for every region that sees a detection, with its cell and whether it is the home; what does not enter the order stays at home.

    A detection that meets nothing is at home outside the grids, spread by its hash.
    """
    box = _boxes()
    meets = reduce(Column.__and__, (F.col(c).isNotNull() for c in own if c == "cls"), placeable(box))
    level, (low, high) = F.greatest(level_of(box), F.lit(lowest)), partner_levels(box, threshold)
    ends = F.greatest(low, F.lit(lowest)), F.greatest(level, F.least(high, F.lit(highest)))
    low, high, level = (F.when(meets, n).otherwise(NOWHERE) for n in (*ends, level))
    homes = rows.withColumn("nms_home_level", grid_level(level))
    spread = in_cells(homes, box, low, high, lambda n: reach(box, n, threshold), REGION_SIDES, F.xxhash64(*names))
    cell, x, y = (F.col(c) for c in CELL)
    here = reduce(Column.__and__, (a == b for a, b in zip((x, y), centre_cell(box, cell, REGION_SIDES))))
    home = F.when(cell < FINEST, True).otherwise((cell == F.col("nms_home_level")) & here)
    ranked = {*own, "tile_id", "det_id", "cls", *CORNERS, "conf"}
    told = spread.withColumn(HOME, home)
    return told.select(*(F.col(c) if c in ranked else F.when(F.col(HOME), F.col(c)).alias(c) for c in names), KNOWN, HOME, *CELL)


def _walked(dealt: DataFrame, detections: DataFrame, own: list[str], threshold: float) -> DataFrame:
    """The detections that their home regions keep or leave open, with that fate as ``KNOWN``."""
    names = detections.columns
    sorted_rows = dealt.withColumns(_region(own)).sortWithinPartitions(*REGION, *_rank_values(detections))
    level = F.when(F.col(CELL[0]) >= FINEST, F.col(CELL[0])).alias("nms_level")
    walked = sorted_rows.select(*REGION, level, HOME, KNOWN, *(c.alias(name) for c, name in zip(_boxes(), BOX)), *names)
    schema = T.StructType([*detections.schema.fields, T.StructField(KNOWN, T.IntegerType())])
    return walked.mapInArrow(_Region(threshold, names).settle, schema)


class _Region:
    """Goes through the detections of each region from the best one down; only kept and open ones are remembered."""

    def __init__(self, threshold: float, names: list[str]):
        self.threshold, self.names = threshold, names
        self.wide = centre_reach(threshold) if threshold > 0 else None
        # Boxes that meet others of any size look far, and take coarse cells.
        self.cell = 1 / FINE if _few_levels(threshold) else 0.5

    def settle(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, side, largest = None, 1.0, 0.0
        near: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            rows, fates = [], []
            columns = [batch.column(c).to_pylist() for c in (*REGION, "nms_level", HOME, KNOWN, *BOX)]
            for row, (a, b, level, home, known, x1, y1, x2, y2) in enumerate(zip(*columns)):
                if level is None:
                    # Outside the grids nothing meets.
                    rows.append(row)
                    fates.append(KEPT)
                    continue
                if (a, b) != region:
                    region, side, largest, near = (a, b), 2.0**level * self.cell, 0.0, {}
                box = (x1, y1, x2, y2, (x2 - x1) * (y2 - y1))
                fate = KEPT if known == KEPT else self._fate(near, side, largest, box, home)
                if fate == STRUCK:
                    continue
                near.setdefault((int((x1 + x2) / 2 // side), int((y1 + y2) / 2 // side)), []).append((*box, fate))
                largest = max(largest, x2 - x1, y2 - y1)
                if home and known == OPEN:
                    rows.append(row)
                    fates.append(fate)
            left = batch.select(self.names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(fates, pa.int32())], names=[*self.names, KNOWN])

    def _fate(self, near: dict, side: float, largest: float, box: tuple, home: bool) -> int:
        x1, y1, x2, y2, area = box
        fate = KEPT if home else OPEN
        wide, high = x2 - x1, y2 - y1
        if self.wide is None:
            far_x, far_y = (wide + largest) / 2, (high + largest) / 2
        else:
            far_x, far_y = wide * self.wide + SLACK, high * self.wide + SLACK
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        for i in range(int((x - far_x) // side), int((x + far_x) // side) + 1):
            for j in range(int((y - far_y) // side), int((y + far_y) // side) + 1):
                for a1, b1, a2, b2, other, known in near.get((i, j), ()):
                    if a1 < x2 and x1 < a2 and b1 < y2 and y1 < b2:
                        shared = (min(x2, a2) - max(x1, a1)) * (min(y2, b2) - max(y1, b1))
                        if shared / max(area + other - shared, 1e-9) > self.threshold:
                            if known == KEPT:
                                return STRUCK
                            fate = OPEN
        return fate
