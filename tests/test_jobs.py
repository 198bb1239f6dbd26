import pytest
from pyspark.sql import functions as F

from packetsieve.catalog.packets import daily_rows, packets, write_captures
from packetsieve.operators.features import stage_packets
from packetsieve.operators.runs import latest_runs, latest_training, run_events, training_log
from packetsieve.plans import analyse_capture, analyse_range, score, train
from packetsieve.plans.train import fit_tables, mode_settings
from packetsieve.session import shared_folder
from packetsieve.sources.captures import training_captures
from packetsieve.sources.model_store import load_model, model_info

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    return str(tmp_path_factory.mktemp("store"))


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("captures") / "daily")
    return write_captures(daily_rows(packets(spark, TABLES)), folder)


@pytest.fixture(scope="module")
def trained(spark, captures, store):
    return train(spark, captures, store, "harcore", "2024-01-01", "2024-01-20").first()


def test_train_records_model_and_phases(spark, store, trained):
    assert trained["folder_name"] == "2024-01-01_2024-01-20"
    assert (trained["mode"], trained["mode_applied"]) == ("harcore", "normal")
    assert trained["n_features"] == 16 and 0 < trained["num_rows"] < 1000
    log = latest_training(training_log(spark, f"{store}/training_log")).first()
    assert log["status"] == "done" and log["elapsed_sec"] > 0
    assert set(log["phases"]) == {"inicio", "preprocessor", "transform", "kmeans", "isoforest"}
    assert {p["status"] for p in log["phases"].values()} == {"done"}
    model = load_model(spark, store, "2024-01-01", "2024-01-20")
    assert model.centroids.count() == 8 and model.scaler.count() == 8
    assert model.forest.select("tree").distinct().count() == 200
    assert model.vocab.select("col").distinct().count() == 8


def test_analyse_range(spark, captures, store, trained):
    outcome = analyse_range(
        spark, captures, "2024-01-01", "2024-01-31", store, "2024-01-01", "2024-01-20"
    ).first()
    result = outcome["result"]
    assert outcome["status"] == "FINISHED" and result["rows"] == 1000
    assert result["folder_name"] == trained["folder_name"] and result["mode"] == "harcore"
    assert result["trained_rows"] == trained["num_rows"]
    assert 0 <= result["anomaly_ratio_iso"] <= 1
    assert -0.5 < result["iso_score_min"] <= result["iso_score_mean"] < 0.5
    assert 0 <= result["kmeans_distance_mean"] <= result["kmeans_distance_max"]
    assert outcome["duration_human"] == "31.00 days"
    run = latest_runs(run_events(spark, f"{store}/run_history"))
    record = run.where(F.col("job_id") == outcome["job_id"]).first()
    assert record["status"] == "FINISHED" and record["progress"] == 100
    assert record["csv_file"] == "2024-01-01_to_2024-01-31"
    assert record["result"]["rows"] == 1000 and record["started_at"] <= record["finished_at"]


def test_analyse_capture_by_name(spark, captures, store, trained):
    one = captures.replace("*.csv", "*2024-01-03*.csv")
    outcome = analyse_capture(spark, one, store, "2024-01-01", "2024-01-20").first()
    assert outcome["duration_seconds"] == 86400.0 and outcome["duration_human"] == "1440.0 minutes"
    assert 0 < outcome["result"]["rows"] < 1000


def test_missing_model_is_recorded_and_raised(spark, captures, store, trained):
    with pytest.raises(LookupError, match="no model global"):
        analyse_capture(spark, captures.replace("*.csv", "*2024-01-03*.csv"), store)
    runs = latest_runs(run_events(spark, f"{store}/run_history"))
    failed = runs.where(F.col("status") == "ERROR").first()
    assert "no model global" in failed["error"] and failed["duration_category"] == "SHORT"
    assert failed["stage"] == "error" and failed["result"] is None


def test_training_without_rows_leaves_no_trace(spark, captures, tmp_path):
    store = str(tmp_path / "empty")
    assert train(spark, captures, store, start="2030-01-01") is None
    assert model_info(spark, store).count() == 0


def test_failed_training_is_logged(spark, tmp_path):
    folder = tmp_path / "bad"
    folder.mkdir()
    from packetsieve.schema import RAW_COLUMNS

    row = ["inf" if c == "frame_len" else "x" for c in RAW_COLUMNS]
    three = [["1" if c == "frame_len" else "x" for c in RAW_COLUMNS]] * 3
    text = "\n".join(",".join(r) for r in [list(RAW_COLUMNS), *three]) + "\n"
    (folder / "a_2024-01-01_x.csv").write_text(text)
    with pytest.raises(ValueError, match="cannot form"):
        train(spark, f"{folder}/*.csv", str(tmp_path / "s"), "low")
    log = latest_training(training_log(spark, f"{tmp_path}/s/training_log")).first()
    assert log["status"] == "failed" and log["phases"]["kmeans"]["status"].startswith("error:")
    (folder / "a_2024-01-01_x.csv").write_text(text + ",".join(row) + "\n")
    with pytest.raises(Exception, match="infinite"):
        train(spark, f"{folder}/*.csv", str(tmp_path / "t"), "low")


def test_saved_model_scores_like_the_fitted_one(spark, captures, store, trained):
    packets_ = stage_packets(training_captures(spark, captures))
    fitted = fit_tables(packets_, 1, 10)
    from packetsieve.sources.model_store import save_model

    save_model(store, fitted, "again", "low", "low", "2024-02-01", 1, 16)
    save_model(store, fitted, "from_earliest_z", "low", "low", "2024-02-01", 1, 16)
    loaded = load_model(spark, store, end="z")
    columns = ["row_id", "cluster", "kmeans_distance", "iso_score"]
    got = score(packets_, loaded).select(*columns)
    want = score(packets_, fitted).select(*columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 1000


def test_later_training_replaces_the_model(spark, captures, tmp_path):
    store = str(tmp_path / "twice")
    train(spark, captures, store, "low", "2024-01-01", "2024-01-03")
    train(spark, captures, store, "low", "2024-01-01", "2024-01-03")
    info = model_info(spark, store)
    assert info.count() == 1
    assert load_model(spark, store, "2024-01-01", "2024-01-03").centroids.count() == 8


def test_modes():
    assert mode_settings("low") == ("low", {"restarts": 5, "trees": 50})
    assert mode_settings("hardcore")[1] == {"restarts": 20, "trees": 500}
    assert mode_settings("odd") == ("normal", {"restarts": 10, "trees": 200})
    with pytest.raises(ValueError):
        mode_settings("odd", strict=True)


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_jobs_leave_no_scratch_tables(spark, captures, tmp_path):
    import os

    folder = os.path.join(shared_folder(spark).removeprefix("file:"), "packetsieve")
    before = set(os.listdir(folder))
    store = str(tmp_path / "clean")
    train(spark, captures, store, "low", "2024-01-01", "2024-01-03")
    analyse_range(spark, captures, "2024-01-01", "2024-01-03", store)
    assert set(os.listdir(folder)) == before
