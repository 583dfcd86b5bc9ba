"""The tile gate end to end: features, split, fit, scores, reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.operators.features import extract_features, fit_gate, score_tiles
from boxmill.operators.splitting import stratified_split
from boxmill.session import write_table


def fit_and_score(tiles: DataFrame, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training part of labelled pixel tiles and score the rest.

    ``tiles``: ``image_id, tile_id, label, height, width, data``. The features are stored because fitting reads them
    many times.
    """
    features = write_table(extract_features(tiles, ["image_id", "tile_id", "label"]), "features")
    key = F.concat_ws("_tile", "image_id", "tile_id")
    parts = write_table(stratified_split(features, key, "label", seed), "gate-parts")
    model = fit_gate(parts.filter("subset = 'train'"))
    scores = score_tiles(model, parts.filter("subset = 'test'"))
    return model, scores.select("image_id", "tile_id", "prob", "label")
