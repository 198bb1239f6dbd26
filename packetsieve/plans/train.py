"""Training: captures in a date range to a saved model."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrival import gaps_between
from ..operators.encoding import vocab_of
from ..operators.features import feature_matrix, fit_counts, stage_measured
from ..operators.isoforest import fit_forest
from ..operators.kmeans import fit_kmeans
from ..operators.runs import RUNNING, append_event
from ..operators.scaling import fit_scaler
from ..schema import DEFAULT_MODE, MODES, TIMESTAMP, TRAINING_LOG_SCHEMA
from ..session import scratch_path, scratch_scope
from ..sources.captures import FILE_NAME, training_captures
from ..sources.model_store import Model, folder_name_of, save_model


def mode_settings(mode: str, strict: bool = False) -> tuple[str, dict[str, int]]:
    """Applied mode and its settings; an unknown mode runs as the default one."""
    if mode in MODES:
        return mode, MODES[mode]
    if strict:
        raise ValueError(f"unknown mode {mode}")
    return DEFAULT_MODE, MODES[DEFAULT_MODE]


class _Phases:
    """Times the phases of one training and writes them to its log."""

    def __init__(self, spark: SparkSession, path: str, entry: str):
        self.spark, self.path, self.entry = spark, path, entry

    def event(self, **fields) -> None:
        append_event(self.spark, self.path, TRAINING_LOG_SCHEMA, entry=self.entry, **fields)

    def run(self, name: str, work, done: bool = True):
        """Do ``work`` as a phase; with ``done`` false only a failure of it is logged."""
        began = time.perf_counter()
        try:
            result = work()
        except Exception as error:
            spent = time.perf_counter() - began
            self.event(
                phases={name: (f"error: {error}", spent)},
                status="failed",
                finished_at=datetime.now().isoformat(),
            )
            raise
        if done:
            self.event(phases={name: ("done", time.perf_counter() - began)})
        return result


def fit_tables(
    packets: DataFrame, restarts: int, trees: int, run=lambda name, work: work(), known: dict | None = None
) -> Model:
    """Fit all model tables on staged packets; ``run`` wraps each phase.

    Categories and timestamps are counted in one scan; ``known`` holds the moments of
    the other columns, taken when the packets were staged. The tables lie in the
    shared folder until they are saved.
    """
    spark = packets.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def preprocessor():
        counts = written(fit_counts(packets), "counts")
        is_time = F.col("col") == TIMESTAMP
        gaps = written(gaps_between(counts.where(is_time & F.col("_first").isNotNull())), "gaps")
        vocab = vocab_of(counts.where(~is_time).select("col", "value", "frequency"))
        return gaps, vocab, written(fit_scaler(packets, gaps, known), "scaler")

    gaps, vocab, scaler = run("preprocessor", preprocessor)
    features = run(
        "transform", lambda: written(feature_matrix(packets, vocab, scaler, gaps), "features")
    )
    centroids = run("kmeans", lambda: fit_kmeans(features, restarts))
    forest = run("isoforest", lambda: written(fit_forest(features, trees), "forest"))
    return Model(vocab, scaler, centroids, forest, None)


def train_rows(
    captured: DataFrame,
    store: str,
    mode: str = DEFAULT_MODE,
    start=None,
    end=None,
    time_format: str | None = None,
    strict_mode: bool = False,
    began: float | None = None,
) -> DataFrame:
    """Train on the rows of captures, save the model and return its info row."""
    began = time.perf_counter() if began is None else began
    spark = captured.sparkSession
    applied, settings = mode_settings(mode, strict_mode)
    name = folder_name_of(start, end)
    width = len([c for c in captured.columns if c != FILE_NAME])
    log = _Phases(spark, f"{store}/training_log", name)

    with scratch_scope(spark):
        log.event(
            folder_name=name,
            mode=mode,
            status=RUNNING,
            n_features=width,
            started_at=datetime.now().isoformat(),
            phases={"inicio": ("done", 0.0)},
        )
        # A failure while staging is one of the preprocessor, and is logged as such.
        packets, known = log.run(
            "preprocessor", lambda: stage_measured(captured, time_format=time_format), done=False
        )
        rows = known["n"]
        log.event(num_rows=rows)
        tables = fit_tables(packets, settings["restarts"], settings["trees"], log.run, known)
        trained_at = datetime.now().isoformat()
        info = log.run(
            "save",
            lambda: save_model(store, tables, name, mode, applied, trained_at, rows, width),
            done=False,
        )
    log.event(
        status="done",
        finished_at=datetime.now().isoformat(),
        elapsed_sec=time.perf_counter() - began,
    )
    return info


def train(
    spark: SparkSession,
    captures: str,
    store: str,
    mode: str = DEFAULT_MODE,
    start=None,
    end=None,
    time_format: str | None = None,
    strict_mode: bool = False,
    same_header: bool = False,
) -> DataFrame | None:
    """Train on the captures under a path pattern; None, and no log entry, without rows."""
    began = time.perf_counter()
    with scratch_scope(spark):  # holds the table of headers
        captured = training_captures(spark, captures, start, end, same_header)
        if captured is None:
            return None
        return train_rows(captured, store, mode, start, end, time_format, strict_mode, began)
