"""From raw packet columns to the 16 model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import (
    fill_category,
    fill_number,
    normalise_flags,
    refuse_infinite,
    to_number,
    to_timestamp,
)
from ..schema import (
    CATEGORICAL,
    FEATURES,
    REQUIRED_COLUMNS,
    ROW_ID,
    STORED_NUMERIC,
    TIMESTAMP,
)
from ..functions.durations import micros_since_epoch
from ..session import scratch_path
from .arrival import inter_arrival_gaps, with_inter_arrival
from .encoding import BROADCAST_BYTES, encode
from .scaling import scale, scaler_constants, stored_moments


def add_missing_numeric(df: DataFrame) -> DataFrame:
    """``df`` with a 0 column for each stored numeric column it lacks."""
    absent = {c: F.lit(0.0) for c in STORED_NUMERIC if c not in df.columns}
    return df.withColumns(absent) if absent else df


def _numeric(df: DataFrame, name: str) -> Column:
    field = df.schema[name]
    number = to_number(F.col(name), is_text=isinstance(field.dataType, T.StringType))
    return fill_number(number).alias(name)


def _categorical(name: str) -> Column:
    if name == "tcp_flags":
        return normalise_flags(F.col(name)).alias(name)
    return fill_category(F.col(name)).alias(name)


def clean_packets(df: DataFrame, keep=(), time_format: str | None = None) -> DataFrame:
    """``keep``, the timestamp, 8 categories and 7 numbers: typed, and filled but for the time.

    A missing timestamp or category column is an error, a missing numeric
    column is 0, and other columns are dropped. Infinite numbers fail the job.
    """
    lacking = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if lacking:
        raise ValueError(f"capture lacks the columns {lacking}")
    df = add_missing_numeric(df)
    typed = df.select(
        *keep,
        to_timestamp(F.col(TIMESTAMP), time_format).alias(TIMESTAMP),
        *[_categorical(c) for c in CATEGORICAL],
        *[_numeric(df, c) for c in STORED_NUMERIC],
    )
    first, *others = [F.col(c) for c in STORED_NUMERIC]
    return typed.withColumn(STORED_NUMERIC[0], refuse_infinite(first, *others))


def stage_packets(df: DataFrame, keep=(), time_format: str | None = None) -> DataFrame:
    """Cleaned packets with a unique row id, written once to the shared folder.

    Later steps read the columns they need from there and see the same ids,
    whatever is recomputed.
    """
    return stage_measured(df, keep, time_format)[0]


def stage_measured(df: DataFrame, keep=(), time_format: str | None = None) -> tuple[DataFrame, dict]:
    """Staged packets, their number (``n``) and the moments of their numbers, taken as they are written."""
    spark = df.sparkSession
    path = scratch_path(spark, "packets")
    seen = Observation()
    cleaned = clean_packets(df, keep, time_format).observe(seen, F.count("*").alias("n"), *stored_moments())
    cleaned.withColumn(ROW_ID, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), seen.get


def fit_counts(packets: DataFrame) -> DataFrame:
    """``(col, value, _first, frequency, row_id)`` of categories and timestamps, from one scan.

    A category has its values, the timestamp its distinct microseconds, each with its
    number of rows and the smallest id that has it.
    """
    no_text, no_time = F.lit(None).cast("string"), F.lit(None).cast("long")
    pairs = [
        F.struct(F.lit(c).alias("col"), F.col(c).alias("value"), no_time.alias("_first")) for c in CATEGORICAL
    ]
    micros = micros_since_epoch(F.col(TIMESTAMP))
    pairs.append(F.struct(F.lit(TIMESTAMP).alias("col"), no_text.alias("value"), micros.alias("_first")))
    long = packets.select(F.explode(F.array(*pairs)).alias("pair"), ROW_ID).select("pair.*", ROW_ID)
    return long.groupBy("col", "value", "_first").agg(
        F.count("*").alias("frequency"), F.min(ROW_ID).alias(ROW_ID)
    )


def select_features(df: DataFrame, keep=()) -> DataFrame:
    """The 16 feature columns in model order, after ``keep``."""
    return df.select(*keep, *FEATURES)


def feature_matrix(
    cleaned: DataFrame,
    vocab: DataFrame,
    scaler: DataFrame,
    gaps: DataFrame | None = None,
    keep=(),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Row id, ``keep`` and 16 numbers per packet: codes, then scaled values.

    The text is replaced by codes before the one shuffle of whole rows, which
    brings in the inter-arrival time, so that shuffle moves numbers only.
    """
    gaps = inter_arrival_gaps(cleaned) if gaps is None else gaps
    coded = encode(cleaned.drop(TIMESTAMP), vocab, broadcast_bytes=broadcast_bytes)
    timed = with_inter_arrival(coded, gaps)
    others = [c for c in keep if c != ROW_ID]
    return select_features(scale(timed, scaler_constants(scaler)), [ROW_ID, *others])


def matrix_column(names=FEATURES) -> Column:
    """The features as one array."""
    return F.array(*[F.col(c) for c in names])
