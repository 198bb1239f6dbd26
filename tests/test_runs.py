import pytest

from packetsieve.operators.runs import (
    append_event,
    compact_events,
    error_durations,
    latest_phases,
    latest_runs,
    latest_training,
    phase_shares,
    require_run,
    run_events,
    training_log,
)
from packetsieve.operators.scoring import attach_model, report_json
from packetsieve.schema import MODEL_INFO_SCHEMA, RUN_EVENT_SCHEMA, TRAINING_LOG_SCHEMA
from packetsieve.sources import event_store


def test_training_log_merges(spark, tmp_path):
    path = str(tmp_path / "log")

    def log(**fields):
        append_event(spark, path, TRAINING_LOG_SCHEMA, entry="global", **fields)

    log(status="running", num_rows=5, phases={"inicio": ("done", 0.0)})
    log(phases={"kmeans": ("error: x", 1.0)})
    log(phases={"kmeans": ("done", 3.0), "transform": ("done", 1.0)})
    log(status="done", elapsed_sec=4.5)
    state = latest_training(training_log(spark, path)).first()
    assert (state["status"], state["num_rows"], state["elapsed_sec"]) == ("done", 5, 4.5)
    assert {k: tuple(v) for k, v in state["phases"].items()} == {
        "inicio": ("done", 0.0), "kmeans": ("done", 3.0), "transform": ("done", 1.0)
    }
    shares = phase_shares(latest_phases(training_log(spark, path))).collect()
    assert {r["phase"]: r["share"] for r in shares} == {
        "inicio": 0.0, "kmeans": 0.75, "transform": 0.25
    }
    with pytest.raises(ValueError, match="colour"):
        log(colour="red")


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "history")

    def event(job, **fields):
        append_event(spark, path, RUN_EVENT_SCHEMA, job_id=job, **fields)

    event("a", status="PENDING", progress=0, csv_file="x.csv")
    event("b", status="PENDING", progress=0)
    event("a", status="RUNNING", progress=1, started_at="2024-01-01T00:00:00")
    event("a", status="ERROR", error="boom")
    runs = {r["job_id"]: r for r in latest_runs(run_events(spark, path)).collect()}
    assert runs["a"]["status"] == "ERROR" and runs["a"]["csv_file"] == "x.csv"
    assert runs["a"]["progress"] == 1 and runs["b"]["status"] == "PENDING"
    require_run(spark, path, "b")
    with pytest.raises(LookupError, match="no run c"):
        require_run(spark, path, "c")


def test_error_durations(spark):
    rows = [("2024-01-01T00:00:00+00:00", "2024-01-01T00:02:00+00:00"), (None, "2024-01-01T00:02:00")]
    runs = spark.createDataFrame(rows, "started_at string, finished_at string").coalesce(1)
    got = error_durations(runs).select(
        "duration_seconds", "duration_human", "duration_category"
    ).collect()
    assert [tuple(r) for r in got] == [(120.0, "2.0 minutes", "SHORT"), (0.0, "0 seconds", "SHORT")]


def test_report_without_model_record(spark):
    report = spark.createDataFrame([("m", 3)], "model_folder string, rows long")
    info = spark.createDataFrame([], MODEL_INFO_SCHEMA)
    got = attach_model(report, info).first()
    assert (got["mode"], got["folder_name"], got["trained_at"]) == ("unknown",) * 3
    assert got["trained_rows"] is None and got["trained_features"] is None
    line = report_json(attach_model(report, info)).first()[0]
    assert '"trained_rows":null' in line and '"mode":"unknown"' in line


def parquet_and_json(folder):
    return [p for p in folder.rglob("*") if p.suffix in (".parquet", ".json") and p.is_file() and not p.name.startswith(".")]


def test_a_thousand_events_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_store, "COMPACT_AFTER", 300)
    path = str(tmp_path / "history")
    for i in range(1000):
        append_event(spark, path, RUN_EVENT_SCHEMA, job_id=f"job{i % 40}", progress=i, error=f"é{i}" if i % 7 == 0 else None)
    events = run_events(spark, path)
    assert events.count() == 1000
    assert compact_events(spark, path, RUN_EVENT_SCHEMA) and not compact_events(spark, path, RUN_EVENT_SCHEMA)
    append_event(spark, path, RUN_EVENT_SCHEMA, job_id="job3", progress=-1)
    assert compact_events(spark, path, RUN_EVENT_SCHEMA)
    assert len(parquet_and_json(tmp_path)) <= 2 * event_store.BUCKETS + 1
    latest = {r["job_id"]: (r["progress"], r["error"]) for r in latest_runs(run_events(spark, path)).collect()}
    assert latest["job3"][0] == -1 and latest["job39"][0] == 999
    assert len(latest) == 40 and latest["job1"][1] == "é" + str(max(i for i in range(1000) if i % 40 == 1 and i % 7 == 0))
    assert run_events(spark, path).count() == 1001


def test_readers_of_the_last_version_survive_a_compaction(spark, tmp_path):
    path = str(tmp_path / "history")
    for i in range(5):
        append_event(spark, path, RUN_EVENT_SCHEMA, job_id="a", progress=i)
    compact_events(spark, path, RUN_EVENT_SCHEMA)
    append_event(spark, path, RUN_EVENT_SCHEMA, job_id="b", progress=7)
    held = run_events(spark, path)
    compact_events(spark, path, RUN_EVENT_SCHEMA)
    assert held.count() == 6 and run_events(spark, path).count() == 6


def test_only_the_bucket_of_a_run_is_read(spark, tmp_path):
    path = str(tmp_path / "history")
    for i in range(60):
        append_event(spark, path, RUN_EVENT_SCHEMA, job_id=f"job{i}", progress=i)
    compact_events(spark, path, RUN_EVENT_SCHEMA)
    append_event(spark, path, RUN_EVENT_SCHEMA, job_id="job7", progress=70)
    one = run_events(spark, path, "job7")
    assert sorted(r["progress"] for r in one.collect()) == [7, 70]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    require_run(spark, path, "job59")
    with pytest.raises(LookupError, match="no run job60"):
        require_run(spark, path, "job60")
    assert run_events(spark, str(tmp_path / "none")).count() == 0


def test_equal_and_backward_clocks_keep_the_order(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    monkeypatch.setattr(event_store.time, "time_ns", lambda: 1000)
    for i in range(4):
        append_event(spark, path, RUN_EVENT_SCHEMA, job_id="a", progress=i)
    # Another writer with a clock that is behind sees what the first one wrote.
    monkeypatch.setattr(event_store, "WRITER", "another")
    monkeypatch.setattr(event_store, "_last", {})
    monkeypatch.setattr(event_store.time, "time_ns", lambda: 10)
    append_event(spark, path, RUN_EVENT_SCHEMA, job_id="a", progress=50)
    assert latest_runs(run_events(spark, path)).first()["progress"] == 50
    compact_events(spark, path, RUN_EVENT_SCHEMA)
    monkeypatch.setattr(event_store, "_last", {})
    append_event(spark, path, RUN_EVENT_SCHEMA, job_id="a", progress=60)
    assert latest_runs(run_events(spark, path)).first()["progress"] == 60
    # Two writers that do not see each other have equal numbers; their names decide.
    for writer, progress in (("w2", 2), ("w1", 1)):
        append_event(spark, path, RUN_EVENT_SCHEMA, job_id="b", seq=77, writer=writer, progress=progress)
    state = latest_runs(run_events(spark, path)).where("job_id = 'b'").first()
    assert state["progress"] == 2 and run_events(spark, path, "b").count() == 2
