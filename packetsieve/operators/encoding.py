"""Ordinal vocabulary of the categorical columns and its lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORICAL, ROW_ID, UNSEEN_CODE
from ..session import scratch_path
from .ordering import ordered_index

# A column's vocabulary is broadcast up to this size; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
# Rough in-memory cost of one broadcast entry beside its text.
ENTRY_BYTES = 64
# Values at least this frequent in training are looked up before the shuffle.
HOT_SHARE = 0.001


def value_counts(df: DataFrame, columns=CATEGORICAL) -> DataFrame:
    """``(col, value, frequency)`` of all columns from one scan, combined before the shuffle."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in columns])
    )
    return (
        df.select(pairs.alias("pair"))
        .groupBy(F.col("pair.col").alias("col"), F.col("pair.value").alias("value"))
        .agg(F.count("*").alias("frequency"))
    )


def fit_vocab(df: DataFrame, columns=CATEGORICAL) -> DataFrame:
    """Codes 0..n-1 of the sorted distinct values of each column."""
    return vocab_of(value_counts(df, columns))


def vocab_of(counts: DataFrame) -> DataFrame:
    """The same from ``(col, value, frequency)``, best a written table, as it is read twice.

    The distinct values are ranked by a range sort over all columns together,
    so one huge vocabulary spreads over all tasks. The table is written once,
    by column.
    """
    spark = counts.sparkSession
    order = [F.col("col").asc(), F.col("value").asc()]
    ranked = ordered_index(counts, order, within=("col",))
    path = scratch_path(spark, "vocab")
    (
        ranked.select("col", "value", F.col("position").cast("double").alias("code"), "frequency")
        .write.partitionBy("col")
        .parquet(path)
    )
    return spark.read.schema("value string, code double, frequency long, col string").parquet(path)


def too_large(vocab: DataFrame, limit: int = BROADCAST_BYTES) -> dict[str, int]:
    """The columns whose vocabulary is over the broadcast limit, with their training rows."""
    sizes = vocab.groupBy("col").agg(
        F.sum(F.octet_length("value") + F.lit(ENTRY_BYTES)).alias("bytes"),
        F.sum("frequency").alias("rows"),
    )
    # One row per column.
    return {r["col"]: r["rows"] for r in sizes.where(F.col("bytes") > limit).collect()}


def _entries(vocab: DataFrame, column: str, code: str) -> DataFrame:
    return vocab.where(F.col("col") == column).select(
        F.col("value").alias("_value"), F.col("code").alias(code), "frequency"
    )


def _encode_shuffled(df: DataFrame, vocab: DataFrame, column: str, hot_rows: float) -> DataFrame:
    """Lookup of a column with a large vocabulary.

    At most ``1 / HOT_SHARE`` values can have ``hot_rows`` rows, so those are
    broadcast. Rows they resolve are spread by row id and do not meet the rest
    of the vocabulary; the others shuffle on their value, where adaptive
    execution splits a value that is hot in this input only.
    """
    is_hot = F.col("frequency") >= F.lit(hot_rows)
    entries = _entries(vocab, column, "_code")
    hot = entries.where(is_hot).select("_value", F.col("_code").alias("_hot"))
    cold = entries.where(~is_hot).select(
        F.col("_value").alias("_key"), F.lit(0).cast("long").alias("_spread"), "_code"
    )
    resolved = F.col("_hot").isNotNull()
    return (
        df.join(F.broadcast(hot), F.col(column) == F.col("_value"), "left")
        .withColumns(
            {
                "_key": F.when(~resolved, F.col(column)),
                "_spread": F.when(resolved, F.col(ROW_ID)).otherwise(F.lit(0)),
            }
        )
        .drop("_value")
        .join(cold, ["_key", "_spread"], "left")
        .withColumn(column, F.coalesce("_hot", "_code", F.lit(UNSEEN_CODE)))
        .drop("_key", "_spread", "_hot", "_code")
    )


def encode(
    df: DataFrame,
    vocab: DataFrame,
    columns=CATEGORICAL,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with each column's text replaced by its code, -1 for a value not in ``vocab``."""
    large = too_large(vocab, broadcast_bytes)
    order = df.columns
    for c in columns:
        if c in large:
            df = _encode_shuffled(df, vocab, c, large[c] * HOT_SHARE)
            continue
        entries = _entries(vocab, c, "_code").select("_value", "_code")
        df = (
            df.join(F.broadcast(entries), F.col(c) == F.col("_value"), "left")
            .withColumn(c, F.coalesce("_code", F.lit(UNSEEN_CODE)))
            .drop("_value", "_code")
        )
    return df.select(*order)

