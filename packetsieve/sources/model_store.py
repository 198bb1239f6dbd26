"""Fitted models as tables, one version per training."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import (
    CENTROID_SCHEMA,
    FOREST_SCHEMA,
    MODEL_INFO_SCHEMA,
    SCALER_SCHEMA,
    VOCAB_SCHEMA,
)

TABLES = {
    "vocab": VOCAB_SCHEMA,
    "scaler": SCALER_SCHEMA,
    "centroids": CENTROID_SCHEMA,
    "forest": FOREST_SCHEMA,
}
KEYS = ("folder_name", "model_id")


@dataclass(frozen=True)
class Model:
    """The five tables of a fitted model."""

    vocab: DataFrame
    scaler: DataFrame
    centroids: DataFrame
    forest: DataFrame
    info: DataFrame


def folder_name_of(start=None, end=None) -> str:
    """Model name for a date range, for callers that hold plain values."""
    if start and end:
        return f"{start}_{end}"
    if start:
        return f"{start}_to_latest"
    if end:
        return f"from_earliest_{end}"
    return "global"


def save_model(
    store: str,
    model: Model,
    folder_name: str,
    mode: str,
    mode_applied: str,
    trained_at: str,
    num_rows: int,
    n_features: int,
) -> DataFrame:
    """Append one version of a model and return its info row.

    The info row is written last, so a save that fails half-way leaves the
    version before it in use.
    """
    spark = model.vocab.sparkSession
    version = uuid.uuid4().hex
    for table in TABLES:
        parts = [*KEYS, "col"] if table == "vocab" else KEYS
        (
            getattr(model, table)
            .withColumns({"folder_name": F.lit(folder_name), "model_id": F.lit(version)})
            .write.mode("append")
            .partitionBy(*parts)
            .parquet(f"{store}/{table}")
        )
    row = (folder_name, mode, mode_applied, trained_at, num_rows, n_features, version)
    info = spark.createDataFrame([row], MODEL_INFO_SCHEMA)
    info.coalesce(1).write.mode("append").parquet(f"{store}/model_info")
    return info


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).exists(target)


def model_info(spark: SparkSession, store: str) -> DataFrame:
    """The latest info row of each model; no row when the store is empty."""
    path = f"{store}/model_info"
    if not _exists(spark, path):
        return spark.createDataFrame([], MODEL_INFO_SCHEMA)
    # One row per training.
    latest = Window.partitionBy("folder_name").orderBy(F.desc("trained_at"), "model_id")
    return (
        spark.read.schema(MODEL_INFO_SCHEMA)
        .parquet(path)
        .withColumn("_rank", F.row_number().over(latest))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def load_model(spark: SparkSession, store: str, start=None, end=None) -> Model:
    """The latest model of a date range; an error when there is none."""
    name = folder_name_of(start, end)
    info = model_info(spark, store).where(F.col("folder_name") == name)
    found = info.first()
    if found is None:
        raise LookupError(f"no model {name} in {store}")
    tables = {
        table: spark.read.schema(f"{schema}, folder_name string, model_id string")
        .parquet(f"{store}/{table}")
        .where((F.col("folder_name") == name) & (F.col("model_id") == found["model_id"]))
        .drop(*KEYS)
        for table, schema in TABLES.items()
    }
    # The row found above, so that a later training does not change the record.
    return Model(**tables, info=spark.createDataFrame([found], MODEL_INFO_SCHEMA))
