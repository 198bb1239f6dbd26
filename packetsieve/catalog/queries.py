"""One query per operator, over the ``packets`` view."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import normalise_flags, to_number, to_timestamp
from ..functions.durations import (
    duration_bucket,
    duration_text,
    elapsed_seconds,
    micros_since_epoch,
    range_span_seconds,
)
from ..functions.names import capture_date, date_field, model_folder_name, name_duration
from ..operators.arrival import inter_arrival_gaps, inter_arrival_moments, with_inter_arrival
from ..operators.encoding import encode, fit_vocab
from ..operators.features import (
    add_missing_numeric,
    feature_matrix,
    select_features,
)
from ..operators.isoforest import FLAG, SCORE, fit_forest, with_iso_score
from ..operators.kmeans import (
    CLUSTER,
    DISTANCE,
    assign,
    centroid_table,
    restart_fits,
    hashed_start,
    lloyd_rounds,
)
from ..operators.ordering import ordered_index
from ..operators.runs import (
    RUNNING,
    append_event,
    compact_events,
    error_durations,
    latest_phases,
    latest_runs,
    latest_training,
    phase_shares,
    run_events,
)
from ..operators.scaling import fit_scaler, scale, scaler_constants
from ..operators.scoring import attach_model, profile, report_json, score_rows, summarise
from ..plans.analyse import analyse_range as run_analysis
from ..plans.analyse import new_record
from ..plans.train import mode_settings, train
from ..schema import (
    CATEGORICAL,
    FEATURES,
    MODES,
    NUMERIC,
    RAW_COLUMNS,
    ROW_ID,
    RUN_EVENT_SCHEMA,
    STORED_NUMERIC,
    TIMESTAMP,
)
from ..session import scratch_path
from ..sources.captures import (
    FILE_NAME,
    captures_in_range,
    list_captures,
    prune_lenient,
    prune_strict,
    read_captures,
    training_captures,
    union_by_name as union_parts,
)
from ..sources.model_store import Model, load_model, save_model
from .packets import (
    SHORT_END,
    TRAIN_END,
    TRAIN_START,
    cleaned,
    daily_rows,
    events,
    packets,
    write_captures,
)

TREES = MODES["low"]["trees"]
ROUNDS = 4
# Rounds after which the compared k-means fit ends at the latest.
FIT_ROUNDS = 12


def _r(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: _r(c) for c in names})


# Sources


def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "captures")
    pattern = write_captures(daily_rows(packets(spark, sf_dir)), folder)
    rows = read_captures(spark, list_captures(spark, pattern))
    return rows.groupBy(FILE_NAME).agg(
        F.count("*").alias("packets"),
        *[F.count(c).alias(f"{c}_set") for c in RAW_COLUMNS],
        F.sum(to_number(F.col("frame_len"))).cast("long").alias("frame_len_sum"),
    )


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select(FILE_NAME).distinct()


def date_prune_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune_strict(_names(spark, sf_dir), "2024-01-10", "2024-01-20").select(
        FILE_NAME, capture_date(F.col(FILE_NAME), True).cast("string").alias("capture_date")
    )


def date_prune_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("date").cast("string")
    kind = F.col("user_id") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("x_"), day, F.lit(".csv")))
        .when(kind == 1, F.concat(F.lit("x_"), F.replace(day, F.lit("-0"), F.lit("-")), F.lit("_y.csv")))
        .when(kind == 2, F.concat(F.lit("x_"), F.replace(day, F.lit("-"), F.lit("")), F.lit("_y.csv")))
        .when(kind == 3, F.lit("noparts.csv"))
        .otherwise(F.concat(F.lit("traffic_"), day, F.lit("_00-00-00.csv")))
    )
    names = events(spark, sf_dir).select(name.alias(FILE_NAME)).distinct()
    return prune_lenient(names, "2024-01-05", "2024-01-20")


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir)
    is_udp = F.col("udp_srcport").isNotNull()
    udp = rows.where(is_udp).select("udp_srcport", "udp_dstport", "frame_number")
    tcp = rows.where(~is_udp).select("frame_number", "tcp_dstport", "tcp_srcport")
    columns = ["frame_number", "tcp_srcport", "tcp_dstport", "udp_srcport", "udp_dstport"]
    return union_parts([udp, tcp]).select(*columns)


def header_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with two headers, whose columns differ in number and order, in one scan."""
    rows = daily_rows(packets(spark, sf_dir))
    is_udp = F.col("udp_srcport").isNotNull()
    udp = ["udp_dstport", "frame_len", "udp_srcport", "frame_number", "dns_qry_name"]
    tcp = ["frame_number", "frame_len", "ip_src", "tcp_flags", "tcp_srcport", "tcp_dstport", "http_request_uri"]
    folder = scratch_path(spark, "captures")
    write_captures(rows.where(is_udp).select(*udp, FILE_NAME), f"{folder}/udp")
    write_captures(rows.where(~is_udp).select(*tcp, FILE_NAME), f"{folder}/tcp")
    read = read_captures(spark, list_captures(spark, f"{folder}/*/*.csv/part-*"))
    return read.groupBy(FILE_NAME).agg(
        F.count("*").alias("packets"),
        *[F.count(c).alias(f"{c}_set") for c in sorted({*udp, *tcp})],
        *[F.sum(F.col(c).cast("long")).alias(f"{c}_sum") for c in ("frame_number", "udp_srcport", "tcp_srcport")],
    )


# Two ranges that hold captures, one before the first and one after the last of them.
RANGES = (("2024-01-03", "2024-01-05"), ("2024-01-12", "2024-01-12"), ("2023-01-01", "2023-12-31"), ("2030-01-01", "2030-01-02"))


def empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of date ranges: training skips an empty one without a word, scoring raises."""
    pattern = write_captures(daily_rows(packets(spark, sf_dir)), scratch_path(spark, "captures"))
    outcomes = []
    for start, end in RANGES:
        captured = training_captures(spark, pattern, start, end)
        rows = None if captured is None else captured.count()
        try:
            raised, scored = False, captures_in_range(spark, pattern, start, end).count()
        except FileNotFoundError:
            raised, scored = True, None
        outcomes.append((start, end, captured is None, rows, raised, scored))
    schema = "range_start string, range_end string, skipped boolean, training_rows long, raised boolean, scoring_rows long"
    return spark.createDataFrame(outcomes, schema)


def _model(spark: SparkSession, sf_dir: str) -> Model:
    """A model of the training range, with fixed-start centroids."""
    rows = cleaned(spark, sf_dir, TRAIN_START, TRAIN_END)
    gaps = inter_arrival_gaps(rows)
    vocab, scaler = fit_vocab(rows), fit_scaler(rows, gaps)
    features = _written(feature_matrix(rows, vocab, scaler, gaps))
    centres = lloyd_rounds(features, hashed_start(features), ROUNDS)
    forest = _written(fit_forest(features, TREES))
    return Model(vocab, scaler, centroid_table(spark, centres), forest, None)


def _written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, "query")
    df.write.parquet(path)
    return spark.read.parquet(path)


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    store = scratch_path(spark, "store")
    save_model(store, model, "global", "low", "low", "2024-02-01T00:00:00", 0, len(RAW_COLUMNS))
    read = load_model(spark, store)
    vocab = read.vocab.select(
        F.lit("vocab").alias("part"), F.col("col").alias("name"), "value", F.col("code").alias("number")
    )
    scaler = read.scaler.select(
        F.lit("scaler").alias("part"),
        F.col("col").alias("name"),
        F.lit("mean").alias("value"),
        _r("mean").alias("number"),
    ).unionByName(
        read.scaler.select(
            F.lit("scaler").alias("part"),
            F.col("col").alias("name"),
            F.lit("scale").alias("value"),
            _r("scale").alias("number"),
        )
    )
    centroids = read.centroids.select(
        F.lit("centroids").alias("part"),
        F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("name"),
        F.posexplode("centre").alias("value", "number"),
    ).withColumns({"value": F.col("value").cast("string"), "number": _r("number")})
    forest = (
        read.forest.groupBy("tree")
        .agg(F.count("*").cast("double").alias("number"))
        .select(
            F.lit("forest").alias("part"),
            F.concat(F.lit("tree "), F.col("tree").cast("string")).alias("name"),
            F.lit("nodes").alias("value"),
            "number",
        )
    )
    return vocab.unionByName(scaler).unionByName(centroids).unionByName(forest)


def model_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("date")
    ranges = (
        events(spark, sf_dir)
        .select(
            F.when(F.col("user_id") % 2 == 0, day).alias("first"),
            F.when(F.col("user_id") % 3 == 0, F.date_add(day, 1)).alias("last"),
        )
        .distinct()
    )
    return ranges.select(
        F.col("first").cast("string").alias("start_date"),
        F.col("last").cast("string").alias("end_date"),
        model_folder_name(F.col("first"), F.col("last")).alias("folder_name"),
    )


# Projections and scalar functions


def timestamp_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = to_timestamp(F.col(TIMESTAMP))
    return packets(spark, sf_dir).select("frame_number", micros_since_epoch(ts).alias("micros"))


def tcp_flags_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = normalise_flags(F.col("tcp_flags"))
    return packets(spark, sf_dir).select("frame_number", flags.alias("tcp_flags"))


def missing_numeric_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir).drop("udp_srcport", "udp_dstport")
    return add_missing_numeric(rows).select(
        "frame_number", "tcp_srcport", "udp_srcport", "udp_dstport"
    )


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir)
    return rows.select(
        ROW_ID,
        *[to_number(F.col(c), c == "http_response_code").alias(c) for c in STORED_NUMERIC],
        to_number(F.col("tcp_flags")).alias("flags_number"),
    )


def categorical_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select(ROW_ID, *CATEGORICAL)


def numeric_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select(ROW_ID, *STORED_NUMERIC)


def feature_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(select_features(with_inter_arrival(cleaned(spark, sf_dir)), [ROW_ID]), ["iat"])


def filename_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col(FILE_NAME)
    return _names(spark, sf_dir).select(
        FILE_NAME,
        date_field(name).alias("date_field"),
        capture_date(name).cast("string").alias("capture_date"),
    )


def filename_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds, text, bucket = name_duration(F.col(FILE_NAME))
    return _names(spark, sf_dir).select(
        FILE_NAME, seconds.alias("seconds"), text.alias("human"), bucket.alias("category")
    )


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", (F.col("value") * F.lit(997.13) - F.lit(10.0)).alias("seconds")
    )


def duration_bucket_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(spark, sf_dir).select(
        "event_id", duration_bucket(F.col("seconds")).alias("category")
    )


def duration_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(spark, sf_dir).select(
        "event_id", duration_text(F.col("seconds")).alias("human")
    )


def _user_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.min("ts").cast("string").alias("start"), F.max("ts").cast("string").alias("end")
    )


def elapsed_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = elapsed_seconds(to_timestamp(F.col("start")), to_timestamp(F.col("end")))
    return (
        _user_spans(spark, sf_dir)
        .withColumn("seconds", seconds)
        .select(
            "user_id",
            _r("seconds").alias("seconds"),
            duration_text(F.col("seconds")).alias("human"),
            duration_bucket(F.col("seconds")).alias("category"),
        )
    )


def range_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = [to_timestamp(F.col(c)).cast("date") for c in ("start", "end")]
    return (
        _user_spans(spark, sf_dir)
        .withColumn("seconds", range_span_seconds(*days))
        .select(
            "user_id",
            "seconds",
            duration_text(F.col("seconds")).alias("human"),
            duration_bucket(F.col("seconds")).alias("category"),
        )
    )


# Order and inter-arrival time


def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = packets(spark, sf_dir).select(ROW_ID, to_timestamp(F.col(TIMESTAMP)).alias("ts"))
    order = [F.col("ts").asc_nulls_last(), F.col(ROW_ID).asc()]
    return ordered_index(times, order).select(ROW_ID, "position")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select(
        ROW_ID, to_timestamp(F.col(TIMESTAMP)).alias(TIMESTAMP)
    )


def inter_arrival_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(with_inter_arrival(_times(spark, sf_dir)).select(ROW_ID, "iat"), ["iat"])


def inter_arrival_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _times(spark, sf_dir)
    return _rounded(
        inter_arrival_moments(rows, inter_arrival_gaps(rows)), ["mean", "deviation", "maximum"]
    )


# Fitted transforms


def ordinal_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_vocab(cleaned(spark, sf_dir)).select("col", "value", "code")


def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    return encode(rows, fit_vocab(rows)).select(ROW_ID, *CATEGORICAL)


def ordinal_encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = fit_vocab(cleaned(spark, sf_dir, TRAIN_START, SHORT_END))
    return encode(cleaned(spark, sf_dir), vocab).select(ROW_ID, *CATEGORICAL)


def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    return _rounded(fit_scaler(rows, inter_arrival_gaps(rows)), ["mean", "scale"])


def scaler_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_rows = cleaned(spark, sf_dir, TRAIN_START, TRAIN_END)
    scaler = scaler_constants(fit_scaler(train_rows, inter_arrival_gaps(train_rows)))
    rows = scale(with_inter_arrival(cleaned(spark, sf_dir)), scaler)
    return _rounded(rows.select(ROW_ID, *NUMERIC), NUMERIC)


def _whole_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    gaps = inter_arrival_gaps(rows)
    return feature_matrix(rows, fit_vocab(rows), fit_scaler(rows, gaps), gaps)


def feature_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_rows = cleaned(spark, sf_dir, TRAIN_START, TRAIN_END)
    vocab = fit_vocab(train_rows)
    scaler = fit_scaler(train_rows, inter_arrival_gaps(train_rows))
    return _rounded(feature_matrix(cleaned(spark, sf_dir), vocab, scaler), FEATURES)


def input_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(packets(spark, sf_dir), list(RAW_COLUMNS))


# Models


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All restarts, so that the stop rule, the costs and the choice can be compared.

    They move for ``FIT_ROUNDS`` rounds at most, as the SQL does.
    """
    features = _written(_whole_matrix(spark, sf_dir))
    return _fits(spark, restart_fits(features, MODES["low"]["restarts"], max_iter=FIT_ROUNDS))


def kmeans_fit_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit as ``train`` runs it, with its own bound of rounds."""
    features = _written(_whole_matrix(spark, sf_dir))
    return _fits(spark, restart_fits(features, MODES["low"]["restarts"]))


def _fits(spark: SparkSession, fits: list) -> DataFrame:
    least = min(round(cost, 3) for cost, _ in fits)
    rows = [
        (restart, round(cost, 3) + 0.0, round(cost, 3) <= least, k, *[float(x) for x in centre])
        for restart, (cost, centres) in enumerate(fits)
        for k, centre in centres
    ]
    columns = ", ".join(f"`{c}` double" for c in FEATURES)
    table = spark.createDataFrame(
        rows, f"restart int, cost double, is_best boolean, cluster int, {columns}"
    )
    # Means of whole numbers can end in an exact half, so the rounding is moved off it.
    return _rounded(table.withColumns({c: F.col(c) + 1e-9 for c in FEATURES}), FEATURES)


def kmeans_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _written(_whole_matrix(spark, sf_dir))
    centres = lloyd_rounds(features, hashed_start(features), ROUNDS)
    table = centroid_table(spark, centres)
    return table.select(
        "cluster", *[_r(F.col("centre")[i]).alias(c) for i, c in enumerate(FEATURES)]
    )


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_rows = cleaned(spark, sf_dir, TRAIN_START, TRAIN_END)
    gaps = inter_arrival_gaps(train_rows)
    vocab, scaler = fit_vocab(train_rows), fit_scaler(train_rows, gaps)
    known = _written(feature_matrix(train_rows, vocab, scaler, gaps))
    centres = lloyd_rounds(known, hashed_start(known), ROUNDS)
    return assign(feature_matrix(cleaned(spark, sf_dir), vocab, scaler), centres)


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select(ROW_ID, CLUSTER)


def kmeans_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_assigned(spark, sf_dir).select(ROW_ID, DISTANCE), [DISTANCE])


def isoforest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = fit_forest(_written(_whole_matrix(spark, sf_dir)), TREES)
    return _rounded(forest, ["threshold"])


def _iso_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train_rows = cleaned(spark, sf_dir, TRAIN_START, TRAIN_END)
    gaps = inter_arrival_gaps(train_rows)
    vocab, scaler = fit_vocab(train_rows), fit_scaler(train_rows, gaps)
    known = _written(feature_matrix(train_rows, vocab, scaler, gaps))
    forest = _written(fit_forest(known, TREES))
    return with_iso_score(feature_matrix(cleaned(spark, sf_dir), vocab, scaler), forest)


def isoforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_iso_scored(spark, sf_dir).select(ROW_ID, SCORE), [SCORE])


def isoforest_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso_scored(spark, sf_dir).groupBy(FLAG).agg(F.count("*").alias("packets"))


METRICS = (
    "iso_score_mean",
    "iso_score_min",
    "anomaly_ratio_iso",
    "kmeans_distance_mean",
    "kmeans_distance_max",
)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)
    features = feature_matrix(cleaned(spark, sf_dir), model.vocab, model.scaler)
    return _rounded(summarise(score_rows(features, model.centroids, model.forest)), METRICS)


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


# Reports and run tables


def _model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model record per day with events, for the days of odd number."""
    day = F.col("ts").cast("date")
    return (
        events(spark, sf_dir)
        .groupBy(day.alias("day"))
        .agg(F.count("*").alias("num_rows"))
        .where(F.dayofmonth("day") % 2 == 1)
        .select(
            model_folder_name(F.col("day"), F.col("day")).alias("folder_name"),
            F.lit("normal").alias("mode"),
            F.concat(F.col("day").cast("string"), F.lit("T23:00:00")).alias("trained_at"),
            "num_rows",
            F.lit(16).alias("n_features"),
        )
    )


def report_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("date")
    reports = (
        events(spark, sf_dir)
        .groupBy(model_folder_name(day, day).alias("model_folder"))
        .agg(F.count("*").alias("rows"), F.max("value").alias("kmeans_distance_max"))
    )
    return attach_model(reports, _model_records(spark, sf_dir))


def score_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("2024-01-15").cast("date")
    report = _summary(spark, sf_dir).withColumn("model_folder", model_folder_name(day, day))
    lines = report_json(attach_model(report, _model_records(spark, sf_dir)))
    schema = (
        "rows long, iso_score_mean double, iso_score_min double, anomaly_ratio_iso double, "
        "kmeans_distance_mean double, kmeans_distance_max double, mode string, "
        "folder_name string, trained_at string, trained_rows long, trained_features int"
    )
    return lines.select(F.from_json("report", schema).alias("r")).select("r.*")


def _training_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events from the test table: one training per day, one phase per event type."""
    state = F.struct(
        F.when(F.col("value") < 1, "error: small").otherwise("done").alias("status"),
        F.col("value").alias("time_sec"),
    )
    return events(spark, sf_dir).select(
        F.col("ts").cast("date").cast("string").alias("entry"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", RUNNING)
        .when(F.col("event_type") != "view", F.col("event_type"))
        .alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("num_rows"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("elapsed_sec"),
        F.create_map(F.col("event_type"), state).alias("phases"),
    )


def training_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_training(
        _training_events(spark, sf_dir), ("status", "num_rows", "elapsed_sec")
    )
    return latest.select(
        "entry",
        "status",
        "num_rows",
        "elapsed_sec",
        F.explode("phases").alias("phase", "state"),
    ).select(
        "entry",
        "status",
        "num_rows",
        "elapsed_sec",
        "phase",
        F.col("state.status").alias("phase_status"),
        F.col("state.time_sec").alias("phase_sec"),
    )


def phase_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = phase_shares(latest_phases(_training_events(spark, sf_dir)))
    return _rounded(
        shares.select("entry", "phase", "time_sec", "total_sec", "share"), ["total_sec", "share"]
    )


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events from the test table: one run per user, states from the event types."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "PENDING")
        .when(kind == "click", "RUNNING")
        .when(kind == "purchase", "FINISHED")
        .when(kind == "error", "ERROR")
    )
    time = F.col("ts").cast("string")
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.when(kind == "click", time).alias("started_at"),
        F.when(kind.isin("purchase", "error"), time).alias("finished_at"),
        F.when(kind == "purchase", F.col("value")).alias("duration_seconds"),
        F.when(kind == "error", F.concat(F.lit("failed at "), time)).alias("error"),
    )


RUN_FIELDS = ("status", "started_at", "finished_at", "duration_seconds", "error")


def run_history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_runs(_run_events(spark, sf_dir), RUN_FIELDS)


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new run for each daily capture, written to a history, put into few files and read back."""
    names = [r[0] for r in daily_rows(packets(spark, sf_dir)).select(FILE_NAME).distinct().collect()]
    history = scratch_path(spark, "history")
    for name in names:
        record = new_record(name, job_id=hashlib.md5(name.encode()).hexdigest())
        append_event(spark, history, RUN_EVENT_SCHEMA, **record)
    compact_events(spark, history, RUN_EVENT_SCHEMA)
    return latest_runs(run_events(spark, history)).select(
        "job_id",
        "csv_file",
        "status",
        "stage",
        "progress",
        F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+\+00:00$").alias("created_utc"),
        *[F.col(c).isNull().alias(f"no_{c}") for c in ("started_at", "finished_at", "result", "error")],
    )


# The mode that a training asks for, by type of event; two of them are not known.
ASKED = {"view": "low", "click": "normal", "purchase": "hardcore", "signup": "quick", "error": "HARDCORE"}


def mode_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked and applied mode with its settings, and how many events ask for it."""
    rows = []
    for kind, asked in ASKED.items():
        applied, settings = mode_settings(asked)
        rows.append((kind, asked, applied, settings["restarts"], settings["trees"]))
    presets = spark.createDataFrame(rows, "event_type string, mode string, mode_applied string, restarts int, trees int")
    counts = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("events"))
    # One row per type of event.
    return counts.join(F.broadcast(presets), "event_type")


def run_error_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error event as a failed run that started when its user's first event came."""
    log = events(spark, sf_dir)
    started = log.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    failed = log.where(F.col("event_type") == "error").join(started, "user_id")
    runs = failed.select(
        "event_id",
        F.when(F.col("event_id") % 4 != 0, F.col("first_ts").cast("string")).alias("started_at"),
        F.col("ts").cast("string").alias("finished_at"),
    )
    return _rounded(error_durations(runs), ["duration_seconds"]).drop("started_at", "finished_at")


# Jobs


def train_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = write_captures(daily_rows(packets(spark, sf_dir)), scratch_path(spark, "captures"))
    info = train(spark, pattern, scratch_path(spark, "store"), mode="low")
    return info.select("folder_name", "mode", "num_rows", "n_features")


def analyse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = write_captures(daily_rows(packets(spark, sf_dir)), scratch_path(spark, "captures"))
    store = scratch_path(spark, "store")
    train(spark, pattern, store, mode="low", start=TRAIN_START, end=TRAIN_END)
    outcome = run_analysis(
        spark, pattern, TRAIN_START, "2024-01-31", store, TRAIN_START, TRAIN_END
    )
    return outcome.select(
        "status",
        "result.rows",
        "result.mode",
        "result.folder_name",
        "result.trained_rows",
        "result.trained_features",
        "duration_seconds",
        "duration_human",
        "duration_category",
    )


QUERIES = {
    "capture_scan": capture_scan,
    "date_prune_strict": date_prune_strict,
    "date_prune_lenient": date_prune_lenient,
    "union_by_name": union_by_name,
    "header_union": header_union,
    "empty_input": empty_input,
    "model_roundtrip": model_roundtrip,
    "model_folder_name": model_folder,
    "timestamp_coerce": timestamp_coerce,
    "tcp_flags_normalise": tcp_flags_normalise,
    "missing_numeric_default": missing_numeric_default,
    "numeric_coerce": numeric_coerce,
    "categorical_fill": categorical_fill,
    "numeric_fill": numeric_fill,
    "feature_select": feature_select,
    "filename_date": filename_date,
    "filename_duration": filename_duration,
    "duration_bucket": duration_bucket_query,
    "duration_text": duration_text_query,
    "elapsed_info": elapsed_info,
    "range_span": range_span,
    "time_order": time_order,
    "inter_arrival_time": inter_arrival_time,
    "inter_arrival_stats": inter_arrival_stats,
    "ordinal_vocab": ordinal_vocab,
    "ordinal_encode": ordinal_encode,
    "ordinal_encode_unseen": ordinal_encode_unseen,
    "scaler_fit": scaler_fit,
    "scaler_transform": scaler_transform,
    "feature_matrix": feature_matrix_query,
    "input_profile": input_profile,
    "kmeans_fit": kmeans_fit,
    "kmeans_lloyd": kmeans_lloyd,
    "kmeans_assign": kmeans_assign,
    "kmeans_distance": kmeans_distance,
    "isoforest_fit": isoforest_fit,
    "isoforest_score": isoforest_score,
    "isoforest_flag": isoforest_flag,
    "score_summary": score_summary,
    "score_report_json": score_report_json,
    "report_with_model": report_with_model,
    "training_log_latest": training_log_latest,
    "phase_share": phase_share,
    "run_history_latest": run_history_latest,
    "run_records": run_records,
    "mode_presets": mode_presets,
    "run_error_duration": run_error_duration,
    "train_small": train_small,
    "analyse_range": analyse_range,
}
#: Queries without SQL: rounds until all restarts stand still are no fixed number.
WITHOUT_SQL = {"kmeans_fit_settled": kmeans_fit_settled}
