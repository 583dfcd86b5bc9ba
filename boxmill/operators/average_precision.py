"""Precision-recall curves and average precision over a global score order per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmill.functions.scores import score_order
from boxmill.operators.matching import IOU_THRESHOLDS
from boxmill.operators.ranking import chunk_totals, earlier_chunks, sorted_chunks
from boxmill.session import small_table, write_table

EPS = 1e-9


def _bit(k: int) -> Column:
    return F.shiftright(F.col("hits"), k).bitwiseAND(1)


class ScoreOrder:
    """Matched predictions, sorted once by class, score descending, image and detection.

    A class may hold most of the rows, so no window spans a class. The rows are range-sorted into files;
    running totals are the totals of the earlier files plus the position inside the file.
    """

    def __init__(self, matched: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS):
        self.thresholds = tuple(thresholds)
        ids = [c for c in ("image_id", "tile_id", "det_id") if c in matched.columns]
        order = [*score_order(F.col("conf")), *map(F.col, ids)]
        # Range sorting reads its input twice (sample, then sort), hence the stored copy.
        stored = write_table(matched, "matched")
        self.rows = sorted_chunks(stored.select("cls", "conf", *ids, "hits"), ["cls"], order)
        self._bits = [f"tp_{k}" for k in range(len(self.thresholds))]
        sums = [F.sum(_bit(k)).alias(name) for k, name in enumerate(self._bits)]
        totals, listed = small_table(chunk_totals(self.rows, ["cls"], *sums), "score-totals")
        # What has a row per class, or per file and class, is no longer than the totals, whose length was checked.
        self._sized = F.broadcast if listed is not None else lambda df: df
        self.totals = totals if listed is None else F.broadcast(totals.coalesce(1))

    def class_counts(self) -> DataFrame:
        """``cls, iou_thr, n_pred, tp``: predictions and true positives of every class."""
        per = self.totals.groupBy("cls").agg(
            F.sum("chunk_rows").alias("n_pred"), *[F.sum(name).alias(name) for name in self._bits]
        )
        pairs = F.array(*[F.struct(F.lit(t).alias("iou_thr"), F.col(n).alias("tp")) for t, n in zip(self.thresholds, self._bits)])
        return per.select("cls", "n_pred", F.inline(pairs))

    def _wide_curve(self) -> DataFrame:
        """Rows that are a true positive somewhere: ``cls, rank, hits`` and per threshold k the columns ``c_k``
        (true positives so far), ``p_k`` (precision) and ``e_k`` (envelope).

        Nothing is stored: the best precision per file and class and the curve itself read the same shuffle.
        """
        size = range(len(self.thresholds))
        window = earlier_chunks(["cls"])
        starts = self.totals.select(
            "chunk", "cls",
            (F.coalesce(F.sum("chunk_rows").over(window), F.lit(0)) - F.col("first_row") + 1).alias("shift"),
            *[F.coalesce(F.sum(n).over(window), F.lit(0)).alias(n) for n in self._bits],
        )
        inside = Window.partitionBy("chunk", "cls")
        ahead = inside.orderBy("chunk_row").rowsBetween(Window.unboundedPreceding, 0)
        tail = inside.orderBy(F.col("chunk_row").desc()).rowsBetween(Window.unboundedPreceding, 0)
        curve = (
            self.rows.filter(F.col("hits") != 0)
            .select("cls", "chunk", "chunk_row", "hits")
            # Moved before anything is added: four columns, and the same shuffle for both readers.
            .repartition("chunk", "cls")
            .join(self._sized(starts), ["chunk", "cls"])
            .withColumn("rank", F.col("chunk_row") + F.col("shift"))
            .withColumns({f"c_{k}": F.col(self._bits[k]) + F.sum(_bit(k)).over(ahead) for k in size})
            .withColumns({f"p_{k}": F.col(f"c_{k}") / (F.col("rank") + F.lit(EPS)) for k in size})
        )
        later = Window.partitionBy("cls").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
        best = curve.groupBy("cls", "chunk").agg(*[F.max(f"p_{k}").alias(f"b_{k}") for k in size]).select(
            "cls", "chunk", *[F.coalesce(F.max(f"b_{k}").over(later), F.lit(0.0)).alias(f"l_{k}") for k in size]
        )
        return (
            curve.withColumns({f"e_{k}": F.max(f"p_{k}").over(tail) for k in size})
            .select("cls", "chunk", "rank", "hits", *[f"{c}_{k}" for c in "cpe" for k in size])
            .join(self._sized(best), ["cls", "chunk"])
            .withColumns({f"e_{k}": F.greatest(f"e_{k}", f"l_{k}") for k in size})
        )

    def curve(self) -> DataFrame:
        """True positives with ``rank, tp_cum, precision, envelope`` per class and threshold.

        Precision falls on every false positive, so the envelope (running maximum from the right) is reached on
        true positives alone and the false positives need not be kept.
        """
        parts = [
            F.struct(
                F.lit(t).alias("iou_thr"), _bit(k).alias("hit"), F.col(f"c_{k}").alias("tp_cum"),
                F.col(f"p_{k}").alias("precision"), F.col(f"e_{k}").alias("envelope"),
            )
            for k, t in enumerate(self.thresholds)
        ]
        return (
            self._wide_curve()
            .select("cls", "rank", F.inline(F.array(*parts)))
            .filter("hit = 1")
            .select("cls", "iou_thr", "rank", "tp_cum", "precision", "envelope")
        )

    def envelope_sums(self) -> DataFrame:
        """``cls`` and per threshold k ``s_k``: sum of the envelope over the true positives, null without one."""
        sums = [F.sum(F.when(_bit(k) == 1, F.col(f"e_{k}"))).alias(f"s_{k}") for k in range(len(self.thresholds))]
        return self._sized(self._wide_curve().groupBy("cls").agg(*sums))


def truth_counts(truth: DataFrame) -> DataFrame:
    """``cls, n_gt``: one row per class with ground truth."""
    return truth.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))


def average_precision(order: ScoreOrder, counts: DataFrame) -> DataFrame:
    """``cls, iou_thr, n_gt, ap`` for every class with ground truth, 0 where nothing was found.

    Recall moves only on a true positive, by 1/n_gt, so AP is the sum of the envelope there.
    """
    per = counts.join(order.envelope_sums(), "cls", "left")
    value = lambda k: F.coalesce(F.col(f"s_{k}") / (F.col("n_gt") + F.lit(EPS)), F.lit(0.0))
    pairs = F.array(*[F.struct(F.lit(t).alias("iou_thr"), value(k).alias("ap")) for k, t in enumerate(order.thresholds)])
    return per.select("cls", "n_gt", F.inline(pairs)).select("cls", "iou_thr", "n_gt", "ap")


def class_ids(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct class ids of predictions and ground truth."""
    return predictions.select("cls").distinct().union(truth.select("cls").distinct()).distinct()


def precision_recall(order: ScoreOrder, counts: DataFrame) -> DataFrame:
    """Micro precision and recall at the first threshold, over classes with ground truth only.

    False positives of a class without ground truth are not counted.
    """
    first = order.class_counts().filter(F.col("iou_thr") == order.thresholds[0])
    per = counts.join(first, "cls", "left").na.fill(0, ["n_pred", "tp"])
    tp, n_pred, n_gt = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "n_pred", "n_gt"))
    return per.agg(tp.alias("tp"), (n_pred - tp).alias("fp"), (n_gt - tp).alias("fn")).select(
        "tp", "fp", "fn",
        (F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(EPS))).alias("precision"),
        (F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(EPS))).alias("recall"),
    )


def mean_average_precision(ap: DataFrame, first_threshold: float = IOU_THRESHOLDS[0]) -> DataFrame:
    """One row: ``map50`` and ``map50_95``, plain means over the classes with ground truth (0 without any)."""
    at_first = F.avg(F.when(F.col("iou_thr") == first_threshold, F.col("ap")))
    return ap.agg(
        F.coalesce(at_first, F.lit(0.0)).alias("map50"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map50_95")
    )
