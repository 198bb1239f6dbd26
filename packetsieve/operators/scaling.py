"""Standard scaling of the numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IAT, NUMERIC, SCALER_SCHEMA, STORED_NUMERIC
from .arrival import inter_arrival_moments


def _scale_of(deviation: Column) -> Column:
    """A column without spread keeps its unit."""
    return F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def stored_moments() -> list[Column]:
    """Mean and population deviation of each stored numeric column, as aggregates."""
    return [
        *[F.avg(c).alias(f"mean_{c}") for c in STORED_NUMERIC],
        *[F.stddev_pop(c).alias(f"dev_{c}") for c in STORED_NUMERIC],
    ]


def fit_scaler(cleaned: DataFrame, gaps: DataFrame, known: dict | None = None) -> DataFrame:
    """``(col, mean, scale)``, with the population deviation as the scale.

    One aggregate over the stored columns and one over the gaps; the rows need
    not be joined with their inter-arrival time for this. ``known`` holds the
    number of rows (``n``) and the moments of the stored columns, if they were
    taken when the rows were written; then no row is read.
    """
    if known is None:
        stored, rows = cleaned.agg(*stored_moments()), cleaned
    else:
        moments = [F.lit(v).cast("double").alias(k) for k, v in known.items() if k != "n"]
        stored, rows = cleaned.sparkSession.range(1).select(*moments), known["n"]
    arrival = inter_arrival_moments(rows, gaps).select(
        F.col("mean").alias(f"mean_{IAT}"), F.col("deviation").alias(f"dev_{IAT}")
    )
    # Both sides are one-row aggregates.
    wide = stored.join(F.broadcast(arrival), F.lit(True))
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("col"),
                    F.col(f"mean_{c}").alias("mean"),
                    _scale_of(F.col(f"dev_{c}")).alias("scale"),
                )
                for c in NUMERIC
            ]
        )
    )
    return wide.select(rows.alias("r")).select("r.*").to(
        cleaned.sparkSession.createDataFrame([], SCALER_SCHEMA).schema
    )


def scaler_constants(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and scale per column; the table has one row per numeric column."""
    return {r["col"]: (r["mean"], r["scale"]) for r in scaler.collect()}


def scale(df: DataFrame, constants: dict[str, tuple[float, float]], columns=NUMERIC) -> DataFrame:
    """``(x - mean) / scale`` for each of ``columns``."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(constants[c][0])) / F.lit(constants[c][1]) for c in columns}
    )
