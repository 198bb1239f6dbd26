"""Reading the tables and cutting lineage with written ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


#: Rows and bytes of one Arrow batch: texts can be long, and tasks hold two batches at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; sets the session's batch limits for the texts in it."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_row(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that none can clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def columns_of(rows: DataFrame) -> DataFrame:
    """The columns that :func:`as_row` packed."""
    return rows.select("row.*")
