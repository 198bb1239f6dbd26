"""Times training, scoring and the operators behind them; prints one JSON line.

Settings: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local threads) and
``BENCH_ROWS`` (packets of a second training, in normal mode on copies of the
events; 0 for none).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from packetsieve.catalog import QUERIES  # noqa: E402
from packetsieve.catalog.packets import daily_rows, events, packets_of, write_captures  # noqa: E402
from packetsieve.operators.runs import latest_phases, training_log  # noqa: E402
from packetsieve.plans import analyse_range, train  # noqa: E402
from packetsieve.session import build_session, drop_paths, scratch_path  # noqa: E402

OPERATORS = (
    "inter_arrival_stats",
    "inter_arrival_time",
    "ordinal_vocab",
    "ordinal_encode",
    "scaler_fit",
    "feature_matrix",
    "time_order",
    "run_history_latest",
    "training_log_latest",
)
FIRST, LAST = "2024-01-01", "2024-01-31"


def copied_events(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    """At least ``rows`` events: copies with ids and times of their own."""
    base = events(spark, sf_dir)
    count = base.count()
    copies = -(-rows // count)
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    return (
        base.repartition(spark.sparkContext.defaultParallelism)
        .withColumn("copy", copy)
        .withColumns(
            {
                "event_id": F.col("event_id") + F.col("copy") * F.lit(count),
                "ts": F.col("ts") + F.make_dt_interval(secs=F.col("copy") * F.lit(0.037)),
            }
        )
        .drop("copy")
        .where(F.col("event_id") < rows)
    )


def timed(times: dict, name: str, work):
    began = time.perf_counter()
    result = work()
    times[name] = round(time.perf_counter() - began, 3)
    return result


def consume(df: DataFrame) -> None:
    """Compute every row and column, and keep none."""
    df.write.format("noop").mode("overwrite").save()


def jobs(spark: SparkSession, rows: DataFrame, times: dict, mode: str, label: str) -> int:
    """Train on capture files of ``rows``, then score them all."""
    captures, store = scratch_path(spark, "captures"), scratch_path(spark, "store")
    pattern = write_captures(daily_rows(packets_of(rows)), captures)
    info = timed(times, f"train_{label}", lambda: train(spark, pattern, store, mode, FIRST, LAST))
    for phase in latest_phases(training_log(spark, f"{store}/training_log")).collect():
        if phase["time_sec"] > 0:
            times[f"train_{label}.{phase['phase']}"] = round(phase["time_sec"], 3)
    report = lambda: analyse_range(spark, pattern, FIRST, LAST, store).collect()
    timed(times, f"score_{label}", report)
    drop_paths(spark, [captures, store])
    return info.first()["num_rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_ROWS", "2726614"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    # Start the workers before the clock.
    QUERIES["inter_arrival_stats"](spark, sf_dir).collect()
    for name in OPERATORS:
        timed(times, name, lambda: consume(QUERIES[name](spark, sf_dir)))
    counted = jobs(spark, events(spark, sf_dir), times, "low", "low")
    sizes = {"train_low": counted}
    if rows:
        label = f"normal_{rows}"
        sizes[f"train_{label}"] = jobs(
            spark, copied_events(spark, sf_dir, rows), times, "normal", label
        )
    total = sum(v for k, v in times.items() if "." not in k)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "packets": sizes,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
