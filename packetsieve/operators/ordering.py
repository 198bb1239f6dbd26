"""Position of every row in a total order, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# monotonically_increasing_id keeps the place within a partition in its low 33 bits.
PLACE_BITS = 33


def ordered_index(
    df: DataFrame, order: list[Column], name: str = "position", within: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` plus its row number (from 0) in the given order, or in each group of ``within``.

    ``order`` starts with the columns of ``within`` and ends in a unique key.
    The rows are range-partitioned and sorted once and written to the shared
    folder, so that partition and place stay fixed, and no key can fill a
    partition. A row's number is then its place plus the sizes of the
    partitions before it; there is one size per partition, and one more per
    group at most. Adaptive execution may merge neighbouring partitions, which
    keeps the order.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    rows = spark.read.parquet(path).withColumns(
        {
            "_part": F.shiftright("_slot", PLACE_BITS),
            "_place": F.col("_slot").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
        }
    )
    sizes = rows.groupBy("_part", *within).agg(
        F.count("*").alias("_size"), F.min("_place").alias("_first")
    )
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        *within,
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    return (
        rows.join(F.broadcast(offsets), ["_part", *within])
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_slot", "_offset")
    )
