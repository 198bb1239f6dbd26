"""Scoring: packets and a model to scored packets and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import feature_matrix
from ..operators.scoring import attach_model, score_rows, summarise
from ..sources.model_store import Model


def score(packets: DataFrame, model: Model, keep=()) -> DataFrame:
    """Staged packets with features, cluster, distance, isolation score and flag."""
    features = feature_matrix(packets, model.vocab, model.scaler, keep=keep)
    return score_rows(features, model.centroids, model.forest)


def score_report(scored: DataFrame, model: Model, folder_name: str) -> DataFrame:
    """One row: the summary and the record of the model that scored."""
    summary = summarise(scored).withColumn("model_folder", F.lit(folder_name))
    return attach_model(summary, model.info)
