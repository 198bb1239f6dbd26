"""Analysis of a capture or a date range, with a record of the run."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import duration_bucket, duration_text, range_span_seconds
from ..functions.names import name_duration
from ..operators.features import stage_packets
from ..operators.runs import append_event, error_durations, require_run
from ..schema import REPORT_TYPE, RUN_EVENT_SCHEMA
from ..session import scratch_scope
from ..sources.captures import captures_in_range, list_captures, read_captures
from ..sources.model_store import folder_name_of, load_model
from .score import score, score_report

REPORT_FIELDS = (
    "rows",
    "iso_score_mean",
    "iso_score_min",
    "anomaly_ratio_iso",
    "kmeans_distance_mean",
    "kmeans_distance_max",
    "mode",
    "folder_name",
    "trained_at",
    "trained_rows",
    "trained_features",
)


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat()


def new_record(csv_file: str, job_id: str | None = None, created_at: str | None = None) -> dict:
    """Fields of a run that waits to start."""
    return {
        "job_id": job_id or str(uuid.uuid4()),
        "csv_file": csv_file,
        "created_at": created_at or now_iso(),
        "progress": 0,
        "stage": "queued",
        "status": "PENDING",
    }


def _one_row(spark: SparkSession, **columns) -> dict:
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def _name_duration(spark: SparkSession, name: str) -> dict:
    seconds, text, bucket = name_duration(F.lit(name))
    return _one_row(
        spark, duration_seconds=seconds, duration_human=text, duration_category=bucket
    )


def _range_duration(spark: SparkSession, start: str, end: str) -> dict:
    seconds = range_span_seconds(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return _one_row(
        spark,
        duration_seconds=seconds,
        duration_human=duration_text(seconds),
        duration_category=duration_bucket(seconds),
    )


def _run_duration(spark: SparkSession, started_at: str | None, finished_at: str) -> dict:
    run = spark.createDataFrame(
        [(started_at, finished_at)], "started_at string, finished_at string"
    )
    columns = ("duration_seconds", "duration_human", "duration_category")
    return error_durations(run).select(*columns).first().asDict()


def _analyse(
    spark: SparkSession,
    label: str,
    rows: DataFrame,
    duration: dict,
    store: str,
    model_start,
    model_end,
    time_format: str | None,
) -> DataFrame:
    """Score ``rows`` and record the run's states; an error is recorded and raised."""
    history = f"{store}/run_history"
    record = new_record(label)
    job_id = record["job_id"]
    append_event(spark, history, RUN_EVENT_SCHEMA, **record)
    started_at = None

    def update(**fields) -> None:
        require_run(spark, history, job_id)
        append_event(spark, history, RUN_EVENT_SCHEMA, job_id=job_id, **fields)

    try:
        started_at = now_iso()
        update(status="RUNNING", started_at=started_at, stage="running", progress=1)
        folder = folder_name_of(model_start, model_end)
        model = load_model(spark, store, model_start, model_end)
        with scratch_scope(spark):
            packets = stage_packets(rows, time_format=time_format)
            report = score_report(score(packets, model), model, folder).first()
        result = tuple(report[f] for f in REPORT_FIELDS)
        update(
            status="FINISHED",
            finished_at=now_iso(),
            stage="done",
            progress=100,
            result=result,
            **duration,
        )
    except Exception as error:
        finished_at = now_iso()
        update(
            status="ERROR",
            finished_at=finished_at,
            stage="error",
            error=str(error),
            **_run_duration(spark, started_at, finished_at),
        )
        raise
    outcome = (job_id, "FINISHED", result, *duration.values())
    return spark.createDataFrame(
        [outcome],
        "job_id string, status string, result "
        f"{REPORT_TYPE}, duration_seconds double, duration_human string, "
        "duration_category string",
    )


def analyse_capture(
    spark: SparkSession,
    path: str,
    store: str,
    model_start=None,
    model_end=None,
    time_format: str | None = None,
) -> DataFrame:
    """Analyse one capture with the global model, or the model of a date range."""
    files = list_captures(spark, path)
    name = files.select("file_name").first()
    if name is None:
        raise FileNotFoundError(path)
    duration = _name_duration(spark, name[0])
    with scratch_scope(spark):  # holds the table of headers
        rows = read_captures(spark, files)
        return _analyse(spark, name[0], rows, duration, store, model_start, model_end, time_format)


def analyse_range(
    spark: SparkSession,
    captures: str,
    start: str,
    end: str,
    store: str,
    model_start=None,
    model_end=None,
    time_format: str | None = None,
    same_header: bool = False,
) -> DataFrame:
    """Analyse the captures of a date range, by default with the model of that range."""
    date.fromisoformat(start), date.fromisoformat(end)
    if model_start is None and model_end is None:
        model_start, model_end = start, end
    duration = _range_duration(spark, start, end)
    with scratch_scope(spark):  # holds the table of headers
        rows = captures_in_range(spark, captures, start, end, same_header)
        return _analyse(
            spark, f"{start}_to_{end}", rows, duration, store, model_start, model_end, time_format
        )
