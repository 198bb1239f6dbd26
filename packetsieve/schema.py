"""Column names, fixed values and table schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Capture columns, in model order.
CATEGORICAL = (
    "frame_protocols",
    "ip_src",
    "ip_dst",
    "dns_qry_name",
    "tls_handshake_extensions_server_name",
    "http_request_method",
    "http_request_uri",
    "tcp_flags",
)
STORED_NUMERIC = (
    "frame_number",
    "frame_len",
    "tcp_srcport",
    "tcp_dstport",
    "udp_srcport",
    "udp_dstport",
    "http_response_code",
)
IAT = "iat"
NUMERIC = (*STORED_NUMERIC, IAT)
FEATURES = (*CATEGORICAL, *NUMERIC)
TIMESTAMP = "timestamp"
RAW_COLUMNS = (TIMESTAMP, *STORED_NUMERIC, *CATEGORICAL)
REQUIRED_COLUMNS = (TIMESTAMP, *CATEGORICAL)

# Text that a capture reader treats as missing.
NULL_SPELLINGS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Fill-ins and codes.
MISSING_CATEGORY = "__NA__"
MISSING_FLAGS = "NA"
UNSEEN_CODE = -1.0
UNKNOWN = "unknown"
NO_DURATION = "INDETERMINADO"

# Model settings.
CLUSTERS = 8
SEED = 42
SAMPLE_PER_TREE = 256
MODES = {
    "low": {"restarts": 5, "trees": 50},
    "normal": {"restarts": 10, "trees": 200},
    "hardcore": {"restarts": 20, "trees": 500},
}
DEFAULT_MODE = "normal"

ROW_ID = "row_id"

VOCAB_SCHEMA = "col string, value string, code double, frequency long"
SCALER_SCHEMA = "col string, mean double, scale double"
CENTROID_SCHEMA = "cluster int, centre array<double>"
FOREST_SCHEMA = (
    "tree int, node int, feature int, threshold double, "
    "`left` int, `right` int, depth int, n_samples int"
)
MODEL_INFO_SCHEMA = (
    "folder_name string, mode string, mode_applied string, trained_at string, "
    "num_rows long, n_features int, model_id string"
)
PHASES_TYPE = "map<string, struct<status: string, time_sec: double>>"
TRAINING_LOG_SCHEMA = (
    "entry string, seq long, writer string, folder_name string, mode string, status string, "
    "num_rows long, n_features int, started_at string, finished_at string, "
    f"elapsed_sec double, phases {PHASES_TYPE}"
)
REPORT_TYPE = (
    "struct<rows: bigint, iso_score_mean: double, iso_score_min: double, "
    "anomaly_ratio_iso: double, kmeans_distance_mean: double, "
    "kmeans_distance_max: double, mode: string, folder_name: string, "
    "trained_at: string, trained_rows: bigint, trained_features: int>"
)
RUN_EVENT_FIELDS = (
    "csv_file",
    "created_at",
    "started_at",
    "finished_at",
    "progress",
    "stage",
    "status",
    "duration_seconds",
    "duration_human",
    "duration_category",
    "result",
    "error",
)
RUN_EVENT_SCHEMA = (
    "job_id string, seq long, writer string, csv_file string, created_at string, "
    "started_at string, finished_at string, progress int, stage string, "
    "status string, duration_seconds double, duration_human string, "
    f"duration_category string, result {REPORT_TYPE}, error string"
)


def text_schema(names) -> T.StructType:
    """A read schema that keeps every column as the text in the file."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])
