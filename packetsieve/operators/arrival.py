"""Inter-arrival time over the whole input.

The gap in front of a timestamp belongs to the first row that carries it; rows
that tie with that row get 0. So the gaps follow from the distinct timestamps,
and rows that share one collapse before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import micros_since_epoch
from ..schema import IAT, ROW_ID, TIMESTAMP

SECOND = 1_000_000
DAY = 86_400 * SECOND


def first_rows(df: DataFrame) -> DataFrame:
    """``(_first, row_id)``: each distinct timestamp in microseconds and the smallest id that has it."""
    times = df.where(F.col(TIMESTAMP).isNotNull())
    times = times.select(micros_since_epoch(F.col(TIMESTAMP)).alias("_first"), ROW_ID)
    return times.groupBy("_first").agg(F.min(ROW_ID).alias(ROW_ID))


def inter_arrival_gaps(df: DataFrame) -> DataFrame:
    """``(row_id, iat)`` for the rows that have a gap in front of them.

    Every row left out has an inter-arrival time of 0. ``row_id`` must be
    unique; it breaks ties in time.
    """
    return gaps_between(first_rows(df))


def gaps_between(times: DataFrame) -> DataFrame:
    """Gaps between the distinct timestamps of :func:`first_rows`.

    The look-back runs per second, then per day over the first rows of each
    second, then over the first rows of each day. A second holds at most a
    million distinct timestamps, a day 86,400 seconds, and the calendar 3.7
    million days, so no window grows with the input.
    """
    times = times.select("_first", ROW_ID).withColumn("_last", F.col("_first"))
    gaps = []
    for width in (SECOND, DAY, None):
        keys = [] if width is None else [F.floor(F.col("_first") / F.lit(width))]
        ordered = Window.partitionBy(*keys).orderBy("_first")
        whole = Window.partitionBy(*keys)
        seen = times.withColumns(
            {"_before": F.lag("_last").over(ordered), "_end": F.max("_last").over(whole)}
        )
        gaps.append(
            seen.where(F.col("_before").isNotNull()).select(
                ROW_ID, ((F.col("_first") - F.col("_before")) / F.lit(1e6)).alias(IAT)
            )
        )
        times = seen.where(F.col("_before").isNull()).select(
            "_first", ROW_ID, F.col("_end").alias("_last")
        )
    return gaps[0].unionByName(gaps[1]).unionByName(gaps[2])


def with_inter_arrival(df: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """``df`` plus ``iat`` in seconds. The join key is unique, so no partition is hot."""
    gaps = inter_arrival_gaps(df) if gaps is None else gaps
    return df.join(gaps, ROW_ID, "left").withColumn(IAT, F.coalesce(F.col(IAT), F.lit(0.0)))


def inter_arrival_moments(rows: DataFrame | int, gaps: DataFrame) -> DataFrame:
    """One row: count, mean, population deviation and maximum of ``iat``.

    ``rows`` is only counted, or their number. The rows without a gap are zeros, so
    their share merges into the moments of the gaps without a join.
    """
    if isinstance(rows, int):
        count = gaps.sparkSession.range(1).select(F.lit(rows).cast("long").alias("n"))
    else:
        count = rows.agg(F.count("*").alias("n"))
    known = gaps.agg(
        F.count("*").alias("m"),
        F.coalesce(F.avg(IAT), F.lit(0.0)).alias("gap_mean"),
        F.coalesce(F.var_pop(IAT), F.lit(0.0)).alias("gap_var"),
        F.coalesce(F.max(IAT), F.lit(0.0)).alias("gap_max"),
    )
    m, n = F.col("m"), F.col("n")
    square_sum = m * F.col("gap_var") + F.pow("gap_mean", F.lit(2)) * m * (n - m) / n
    # Both sides are one-row aggregates.
    return count.join(F.broadcast(known), F.lit(True)).select(
        "n",
        F.when(n > 0, m * F.col("gap_mean") / n).alias("mean"),
        F.when(n > 0, F.sqrt(square_sum / n)).alias("deviation"),
        F.when(n > 0, F.col("gap_max")).alias("maximum"),
    )
