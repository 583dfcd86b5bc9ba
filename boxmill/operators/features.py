"""Tile features and the fitted tile gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.functions.pixels import FEATURES, tile_features

# Pixel bytes that are stacked into one numpy call: one tile of common size, or many small ones.
STACK_BYTES = 2 << 20

MAX_ITERATIONS = 2000


def extract_features(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` plus the 16 features of every tile: ``height, width, data`` (row-wise BGR bytes).

    Runs inside the tasks on Arrow batches; tiles of one size are stacked and handled by one numpy call.
    """
    kinds = [f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join(kinds + [f"{f} double" for f in FEATURES])

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (h, w), same_size in batch.groupby(["height", "width"], sort=False):
                per_call = max(1, STACK_BYTES // (int(h) * int(w) * 3))
                for at in range(0, len(same_size), per_call):
                    part = same_size.iloc[at : at + per_call]
                    stack = np.stack([np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3) for d in part["data"]])
                    values = pd.DataFrame(tile_features(stack), columns=list(FEATURES), index=part.index)
                    yield pd.concat([part[keys], values], axis=1)

    return tiles.select(*keys, "height", "width", "data").mapInPandas(featurise, schema)


def standardised(features: DataFrame) -> DataFrame:
    """Every feature less its mean, divided by its population deviation; a constant feature becomes 0."""
    totals = features.agg(
        *[F.avg(f).alias(f"mean_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"deviation_{f}") for f in FEATURES]
    )
    scaled = {f: (F.col(f) - F.col(f"mean_{f}")) / F.when(F.col(f"deviation_{f}") > 0, F.col(f"deviation_{f}")).otherwise(1.0) for f in FEATURES}
    return features.crossJoin(F.broadcast(totals)).select([scaled[c].alias(c) if c in scaled else c for c in features.columns])


def class_weights(features: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, weight`` per class: all rows divided by twice the rows of the class."""
    counts = features.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("whole") / (2 * F.col("n"))).alias("weight"))


def linear_scores(features: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    """Adds ``prob`` of a logistic model with given coefficients."""
    z = sum((F.col(f) * c for f, c in coefficients.items()), F.lit(intercept))
    return features.withColumn("prob", 1 / (1 + F.exp(-z)))


def fit_gate(features: DataFrame, label: str = "label") -> PipelineModel:
    """Standardised, class-balanced, L2-regularised logistic regression on the tile features.

    The loss equals the usual form "half the squared weights plus the summed weighted log loss" on features divided by
    the population deviation. Spark averages the loss over the weight sum n, hence a penalty of 1/n; its scaler
    divides by the sample deviation, which scales the penalty by (n-1)/n.
    """
    counts = features.agg(
        F.count_if(F.col(label) == 0).alias("without"), F.count_if(F.col(label) == 1).alias("with"), F.count(F.lit(1)).alias("all")
    ).first()
    n = counts["all"]
    if not counts["without"] or not counts["with"] or counts["without"] + counts["with"] != n:
        raise ValueError("fitting needs tiles with and without an object, labelled 1 and 0")
    balanced = F.when(F.col(label) == 1, n / (2 * counts["with"])).otherwise(n / (2 * counts["without"]))
    weighted = features.withColumn("weight", balanced).withColumn("target", F.col(label).cast("double"))
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="scaled", labelCol="target", weightCol="weight", maxIter=MAX_ITERATIONS,
            regParam=(n - 1) / n**2, standardization=False,
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def gate_coefficients(model: PipelineModel, rows: int) -> tuple[dict[str, float], float]:
    """Coefficients on ``standardised`` features, and the intercept, of a gate fitted to so many rows.

    The fit divides by the sample deviation, ``standardised`` by the population's.
    """
    fitted = model.stages[-1]
    factor = ((rows - 1) / rows) ** 0.5
    return {f: float(c) * factor for f, c in zip(FEATURES, fitted.coefficients)}, float(fitted.intercept)


def loss_gradient(features: DataFrame, coefficients: dict[str, float], intercept: float, label: str = "label") -> DataFrame:
    """``feature, gradient``: the slope of the gate's loss per row at the given coefficients, one row each and one for ``intercept``.

    The loss is half the squared coefficients plus the balanced log loss. At its lowest point all slopes are 0, which
    makes this a proof that a fit is one, however it was found. One pass over the rows.
    """
    counts = {r[label]: r["weight"] for r in class_weights(features, label).select(label, "weight").collect()}
    weight = F.when(F.col(label) == 1, counts.get(1)).otherwise(counts.get(0))
    scored = linear_scores(standardised(features), coefficients, intercept)
    miss = weight * (F.col("prob") - F.col(label))
    slopes = [F.struct(F.lit(f).alias("feature"), ((F.sum(miss * F.col(f)) + c) / F.count(F.lit(1))).alias("gradient")) for f, c in coefficients.items()]
    slopes.append(F.struct(F.lit("intercept").alias("feature"), (F.sum(miss) / F.count(F.lit(1))).alias("gradient")))
    return scored.agg(F.array(*slopes).alias("slopes")).select(F.inline("slopes"))


def save_linear(spark: SparkSession, coefficients: dict[str, float], intercept: float, path: str) -> None:
    """A linear gate as a table ``feature, coefficient``; the intercept is a row of that name."""
    rows = [*coefficients.items(), ("intercept", intercept)]
    spark.createDataFrame(rows, "feature string, coefficient double").coalesce(1).write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> tuple[dict[str, float], float]:
    """Coefficients and intercept of a gate stored by ``save_linear``: a row per feature."""
    rows = {r["feature"]: r["coefficient"] for r in spark.read.parquet(path).collect()}
    return {f: rows[f] for f in FEATURES if f in rows}, rows["intercept"]


def score_tiles(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Adds ``prob``: probability that the tile has an object."""
    scored = model.transform(features)
    return scored.select(*features.columns, vector_to_array("probability")[1].alias("prob"))


def save_gate(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_gate(path: str) -> PipelineModel:
    return PipelineModel.load(path)
