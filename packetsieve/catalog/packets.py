"""The capture schema as a view over the ``events`` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import date_field
from ..operators.features import clean_packets
from ..schema import RAW_COLUMNS, ROW_ID
from ..sources.captures import FILE_NAME

# The same text runs in Spark and in DuckDB.
PACKETS_SELECT = """
SELECT
 CASE WHEN event_id % 97 = 5 THEN 'bad' ELSE CAST(ts AS VARCHAR(64)) END AS timestamp,
 event_id AS frame_number,
 CAST(60 + floor(value * 3) AS BIGINT) AS frame_len,
 concat('eth:ethertype:ip:', CASE WHEN event_type = 'view' THEN 'udp:dns' WHEN event_type = 'purchase' THEN 'tcp:tls' WHEN event_type IN ('click','signup') THEN 'tcp:http' ELSE 'tcp' END) AS frame_protocols,
 concat('10.0.0.', CAST(user_id AS VARCHAR(20))) AS ip_src,
 concat('10.1.0.', CAST(event_id % 50 AS VARCHAR(20))) AS ip_dst,
 CASE WHEN event_type = 'view' THEN concat('h', CAST(user_id % 20 AS VARCHAR(20)), '.example') END AS dns_qry_name,
 CASE WHEN event_type = 'purchase' THEN concat('shop', CAST(user_id % 7 AS VARCHAR(20)), '.example') END AS tls_handshake_extensions_server_name,
 CASE WHEN event_type = 'click' THEN 'GET' WHEN event_type = 'signup' THEN 'POST' END AS http_request_method,
 CASE WHEN event_type IN ('click','signup') THEN concat('/p/', CAST(event_id % 300 AS VARCHAR(20))) END AS http_request_uri,
 CASE WHEN event_type = 'view' THEN NULL WHEN event_id % 13 = 0 THEN '' WHEN event_id % 3 = 0 THEN '0x0002' ELSE '0x0018' END AS tcp_flags,
 CASE WHEN event_type <> 'view' THEN 1024 + (user_id * 37) % 60000 END AS tcp_srcport,
 CASE WHEN event_type = 'purchase' THEN 443 WHEN event_type <> 'view' THEN 80 END AS tcp_dstport,
 CASE WHEN event_type = 'view' THEN 1024 + (user_id * 41) % 60000 END AS udp_srcport,
 CASE WHEN event_type = 'view' THEN 53 END AS udp_dstport,
 CASE WHEN event_type = 'click' THEN '200' WHEN event_type = 'error' AND event_id % 17 = 0 THEN '5xx' WHEN event_type = 'error' THEN '500' END AS http_response_code,
 concat('traffic_', CAST(CAST(ts AS DATE) AS VARCHAR(20)), '_00-00-00_(', CAST(CAST(1 + user_id % 90 AS BIGINT) AS VARCHAR(20)), '.0_minutes)_(0.06_input)_(0.05_output).csv') AS file_name
 FROM {events}
"""

# The training range of the queries that score against a model of other days.
TRAIN_START, TRAIN_END = "2024-01-01", "2024-01-15"
# A range short enough that scoring meets values it does not hold.
SHORT_END = "2024-01-01"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets_of(events: DataFrame) -> DataFrame:
    """Packets with their file name, and the frame number as row id."""
    rows = events.sparkSession.sql(PACKETS_SELECT, events=events)
    return rows.withColumn(ROW_ID, F.col("frame_number"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(events(spark, sf_dir))


def within(df: DataFrame, start: str, end: str) -> DataFrame:
    """The packets of captures dated in a range."""
    return df.where(date_field(F.col(FILE_NAME)).between(start, end))


def cleaned(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Cleaned packets of a range of capture dates, of all when open."""
    rows = packets(spark, sf_dir)
    if start is not None:
        rows = within(rows, start, end)
    return clean_packets(rows, keep=[ROW_ID])


def daily_rows(packets: DataFrame) -> DataFrame:
    """Packets as text, with one capture name per day."""
    name = F.concat(
        F.lit("traffic_"),
        date_field(F.col(FILE_NAME)),
        F.lit("_00-00-00_(1440.0_minutes)_(0.06_input)_(0.05_output).csv"),
    )
    return packets.select(*[F.col(c).cast("string") for c in RAW_COLUMNS], name.alias(FILE_NAME))


def write_captures(df: DataFrame, folder: str) -> str:
    """Write rows as capture files, one folder of part files per ``file_name``.

    A name with more rows than a task should sort gets several part files. Returns the pattern to read them with.
    """
    (
        df.hint("rebalance", FILE_NAME)
        .write.partitionBy(FILE_NAME)
        .option("header", True)
        .option("escape", '"')
        .csv(folder)
    )
    return f"{folder}/*.csv/part-*"
