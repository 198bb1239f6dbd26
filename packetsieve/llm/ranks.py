"""Row numbers within groups, by ranges: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written


def ranked(rows: DataFrame, key: str, order: list, label: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in ``order`` within ``key``) and ``total`` (rows of the key).

    ``key`` is never null. Ranges over key and order spread a hot key over all
    tasks. They are written with their place in them, and the rows of a key in the
    ranges before are added: a sum over one row for each key and range.
    """
    sorted_rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = written(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), label)
    held = placed.groupBy(key, "_range").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    ranges = Window.partitionBy(key)
    before = ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        key,
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(ranges).alias("total"),
    )
    joined = placed.join(starts, [key, "_range"])
    return joined.withColumn("rank", F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")
