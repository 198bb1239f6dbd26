from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from packetsieve.functions import (
    capture_date,
    capture_file_name,
    duration_bucket,
    duration_text,
    elapsed_seconds,
    fill_category,
    model_folder_name,
    name_duration,
    normalise_flags,
    null_spellings_to_null,
    range_span_seconds,
    to_number,
    to_timestamp,
)
from packetsieve.functions.cleaning import refuse_infinite
from packetsieve.functions.durations import micros_since_epoch
from packetsieve.schema import NULL_SPELLINGS
from packetsieve.sources.model_store import folder_name_of

NAME = "traffic_2026-02-10_03-20-01_(10.0_minutes)_(0.06_input)_(0.05_output).csv"


def evaluate(spark, values, kind, *columns):
    """One list of results per column expression over a column ``v``."""
    df = spark.createDataFrame([(x,) for x in values], f"v {kind}")
    rows = df.coalesce(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    results = [[r[i] for r in rows] for i in range(len(columns))]
    return results[0] if len(columns) == 1 else results


def v():
    return F.col("v")


def test_durations(spark):
    seconds = [-1.0, 0.0, 59.94, 60.0, 299.9, 300.0, 3599.0, 3600.0, 86399.0, 86400.0, 172799.0, None]
    bucket, text = evaluate(spark, seconds, "double", duration_bucket(v()), duration_text(v()))
    assert bucket == [
        "SHORT", "SHORT", "SHORT", "SHORT", "SHORT", "MEDIUM", "MEDIUM", "LONG", "LONG",
        "VERY_LONG", "VERY_LONG", None,
    ]
    assert text == [
        "-1.0 seconds", "0.0 seconds", "59.9 seconds", "1.0 minutes", "5.0 minutes",
        "5.0 minutes", "60.0 minutes", "1.00 hours", "24.00 hours", "1.00 days", "2.00 days", None,
    ]


def test_elapsed_and_span(spark):
    pair = spark.createDataFrame(
        [("2026-02-10T10:00:00+00:00", "2026-02-10T10:00:04.200000+00:00")], "a string, b string"
    )
    got = pair.select(elapsed_seconds(to_timestamp(F.col("a")), to_timestamp(F.col("b")))).first()
    assert got[0] == 4.2
    days = spark.createDataFrame([(date(2024, 2, 28), date(2024, 3, 1))], "a date, b date")
    assert days.select(range_span_seconds(F.col("a"), F.col("b"))).first()[0] == 3 * 86400 - 1


def test_file_names(spark):
    names = [NAME, "x_2026-02-10.csv", "x_2026-2-1_y.csv", "x_20260210_y.csv", "noparts.csv"]
    lenient, strict = evaluate(spark, names, "string", capture_date(v()), capture_date(v(), True))
    day = date(2026, 2, 10)
    assert lenient == [day, day, None, None, None]
    assert strict == [day, None, None, None, None]
    seconds, text, bucket = evaluate(
        spark, [NAME, "a_(1.2.3_minutes).csv", "a_(_minutes).csv", "plain.csv"], "string",
        *name_duration(v()),
    )
    assert seconds == [600.0, None, None, None]
    assert text == ["10.0 minutes", "INDETERMINADO", "INDETERMINADO", "INDETERMINADO"]
    assert bucket == ["MEDIUM", None, None, None]


def test_capture_name_of_paths(spark):
    paths = [f"file:/d/{NAME}", f"/d/{NAME}/part-0.csv", f"/d/file_name={NAME}/part-0.csv", NAME]
    assert evaluate(spark, paths, "string", capture_file_name(v())) == [NAME] * 4
    assert evaluate(spark, ["/d/a%20b+c.csv"], "string", capture_file_name(v())) == ["a b+c.csv"]


def test_timestamps(spark):
    texts = ["2024-03-10 02:30:00.123456789", "2024-01-01T10:00:00", "bad", None, "", "1704067200"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times, micros = evaluate(
            spark, texts, "string", to_timestamp(v()), micros_since_epoch(to_timestamp(v()))
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert times[:2] == [datetime(2024, 3, 10, 2, 30, 0, 123456), datetime(2024, 1, 1, 10)]
    assert times[2:] == [None] * 4
    assert micros[:2] == [1710037800123456, 1704103200000000]
    custom = to_timestamp(v(), "dd/MM/yyyy HH:mm")
    assert evaluate(spark, ["02/01/2024 03:04", "bad"], "string", custom) == [
        datetime(2024, 1, 2, 3, 4),
        None,
    ]


def test_numbers(spark):
    texts = [" 12 ", "1e3", "0x18", "1,5", "", "5xx", "24d", "24f", "NaN", "inf", "+5", None]
    got = evaluate(spark, texts, "string", to_number(v()))
    assert got == [12.0, 1000.0, None, None, None, None, None, None, None, float("inf"), 5.0, None]


def test_infinite_numbers_fail(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, float("-inf"))], "a double, b double")
    with pytest.raises(Exception, match="infinite value"):
        df.select(refuse_infinite(F.col("a"), F.col("b"))).collect()
    df = spark.createDataFrame([(1.0, 2.0)], df.schema)
    assert df.select(refuse_infinite(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_categories(spark):
    assert evaluate(spark, [None, "", "24"], "string", normalise_flags(v())) == ["NA", "NA", "24"]
    assert evaluate(spark, [None, "", "é"], "string", fill_category(v())) == ["__NA__", "", "é"]
    assert evaluate(spark, list(NULL_SPELLINGS), "string", null_spellings_to_null(v())) == [
        None
    ] * len(NULL_SPELLINGS)
    assert evaluate(spark, ["-", "nA", "0"], "string", null_spellings_to_null(v())) == ["-", "nA", "0"]


def test_model_names(spark):
    ranges = [("2024-01-01", "2024-01-02"), ("2024-01-01", None), (None, "2024-01-02"), (None, None)]
    df = spark.createDataFrame(ranges, "a string, b string").coalesce(1)
    names = [r[0] for r in df.select(model_folder_name(F.col("a"), F.col("b"))).collect()]
    assert names == [
        "2024-01-01_2024-01-02", "2024-01-01_to_latest", "from_earliest_2024-01-02", "global"
    ]
    assert names == [folder_name_of(a, b) for a, b in ranges]
