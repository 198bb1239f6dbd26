"""Training log and run history: append-only events, read as their latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durations import duration_bucket, duration_text, elapsed_seconds
from ..functions.cleaning import to_timestamp
from ..schema import PHASES_TYPE, RUN_EVENT_FIELDS, RUN_EVENT_SCHEMA, TRAINING_LOG_SCHEMA
from ..sources import event_store

TRAINING_FIELDS = (
    "folder_name",
    "mode",
    "status",
    "num_rows",
    "n_features",
    "started_at",
    "finished_at",
    "elapsed_sec",
)


#: The status that a training starts with.
RUNNING = "running"


def append_event(spark: SparkSession, path: str, schema: str, **fields) -> None:
    """Add one event with the given fields; the others are null and change nothing."""
    event_store.append(spark, path, schema, _key(schema), **fields)


def _key(schema: str) -> str:
    """The column that names a run or training: the first one."""
    return T.StructType.fromDDL(schema).names[0]


def compact_events(spark: SparkSession, path: str, schema: str) -> bool:
    """Put the events of a log or history into few files; readers see the same events."""
    return event_store.compact(spark, path, schema, _key(schema))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    return event_store.read(spark, path, TRAINING_LOG_SCHEMA)


def run_events(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """All events, or those of one run, for which other buckets are not read."""
    events = event_store.read(spark, path, RUN_EVENT_SCHEMA, job_id)
    return events if job_id is None else events.where(F.col("job_id") == job_id)


def _order(events: DataFrame):
    """What events are ordered by; the writer tells equal numbers apart."""
    return F.struct("seq", "writer") if "writer" in events.columns else F.col("seq")


def _newest(field: str, order):
    """The value of the last event that sets a field."""
    return F.max_by(field, F.when(F.col(field).isNotNull(), order)).alias(field)


def latest_phases(events: DataFrame) -> DataFrame:
    """``(entry, phase, status, time_sec)``: a later phase of the same name wins."""
    order = _order(events).alias("_order")
    phases = events.select("entry", order, F.explode("phases").alias("phase", "_state"))
    return (
        phases.groupBy("entry", "phase")
        .agg(F.max_by("_state", "_order").alias("_state"))
        .select("entry", "phase", "_state.status", "_state.time_sec")
    )


def latest_training(events: DataFrame, fields=TRAINING_FIELDS) -> DataFrame:
    """State of each training: later fields win, phases merge by name.

    A start (status "running") clears the fields of the run before it; phases
    merge over all runs. Events combine before the shuffle, so an entry with very
    many of them is no hot group. A log has a handful of phase names.
    """
    starts = events.where(F.col("status") == RUNNING).groupBy("entry")
    order = _order(events)
    starts = starts.agg(F.max(order).alias("_start"))
    current = events.join(starts, "entry", "left").where(F.col("_start").isNull() | (order >= F.col("_start")))
    state = current.groupBy("entry").agg(*[_newest(f, order) for f in fields])
    phases = (
        latest_phases(events)
        .groupBy("entry")
        .agg(
            F.map_from_entries(
                F.array_sort(
                    F.collect_list(F.struct("phase", F.struct("status", "time_sec")))
                )
            )
            .cast(PHASES_TYPE)
            .alias("phases")
        )
    )
    return state.join(phases, "entry", "left")


def phase_shares(phases: DataFrame) -> DataFrame:
    """Seconds of each phase and its share of its training's total."""
    totals = phases.groupBy("entry").agg(F.sum("time_sec").alias("total_sec"))
    return phases.join(totals, "entry").withColumn(
        "share", F.when(F.col("total_sec") != 0, F.col("time_sec") / F.col("total_sec"))
    )


def latest_runs(events: DataFrame, fields=RUN_EVENT_FIELDS) -> DataFrame:
    """State of each run: for every field the value of the last event that sets it."""
    return events.groupBy("job_id").agg(*[_newest(f, _order(events)) for f in fields])


def require_run(spark: SparkSession, path: str, job_id: str) -> None:
    """Fail for a run without a record."""
    if run_events(spark, path, job_id).isEmpty():
        raise LookupError(f"no run {job_id} in the history")


def error_durations(runs: DataFrame) -> DataFrame:
    """Run time of failed runs in seconds, text and bucket; 0 for a run that never started."""
    seconds = elapsed_seconds(
        to_timestamp(F.col("started_at")), to_timestamp(F.col("finished_at"))
    )
    started = F.col("started_at").isNotNull()
    return runs.withColumn(
        "duration_seconds", F.when(started, seconds).otherwise(F.lit(0.0))
    ).withColumns(
        {
            "duration_human": F.when(started, duration_text(F.col("duration_seconds"))).otherwise(
                F.lit("0 seconds")
            ),
            "duration_category": duration_bucket(F.col("duration_seconds")),
        }
    )
