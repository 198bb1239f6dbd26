"""Per-packet scores and their one-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import UNKNOWN
from .isoforest import FLAG, SCORE, with_iso_score
from .kmeans import DISTANCE, assign, centres_of


def score_rows(features: DataFrame, centroids: DataFrame, forest: DataFrame) -> DataFrame:
    """``features`` plus cluster, centroid distance, isolation score and flag."""
    return with_iso_score(assign(features, centres_of(centroids)), forest)


def summarise(scored: DataFrame) -> DataFrame:
    """One row: packets, isolation score, share flagged (0..1) and centroid distance."""
    return scored.agg(
        F.count("*").alias("rows"),
        F.avg(SCORE).alias("iso_score_mean"),
        F.min(SCORE).alias("iso_score_min"),
        F.avg(F.col(FLAG).cast("double")).alias("anomaly_ratio_iso"),
        F.avg(DISTANCE).alias("kmeans_distance_mean"),
        F.max(DISTANCE).alias("kmeans_distance_max"),
    )


def attach_model(report: DataFrame, info: DataFrame) -> DataFrame:
    """Report rows with the record of the model that scored them, by ``model_folder``.

    A model without a record is "unknown", with null numbers.
    """
    record = info.select(
        F.col("folder_name").alias("model_folder"),
        F.col("folder_name"),
        "mode",
        F.col("trained_at"),
        F.col("num_rows").alias("trained_rows"),
        F.col("n_features").alias("trained_features"),
    )
    text = {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in ("mode", "folder_name", "trained_at")}
    return report.join(record, "model_folder", "left").withColumns(text)


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: packets and raw columns of an input."""
    width = len(df.columns if columns is None else columns)
    return df.agg(F.count("*").alias("num_rows")).withColumn("n_features", F.lit(width))


def report_json(report: DataFrame) -> DataFrame:
    """Each report as one JSON object; null fields are written."""
    return report.select(
        F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("report")
    )
