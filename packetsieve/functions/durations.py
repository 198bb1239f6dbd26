"""Durations: seconds, readable text and a size bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def duration_bucket(seconds: Column) -> Column:
    """SHORT below 5 minutes, MEDIUM below an hour, LONG below a day, else VERY_LONG."""
    return F.when(
        seconds.isNotNull(),
        F.when(seconds < 5 * MINUTE, "SHORT")
        .when(seconds < HOUR, "MEDIUM")
        .when(seconds < DAY, "LONG")
        .otherwise("VERY_LONG"),
    )


def duration_text(seconds: Column) -> Column:
    """Seconds in the largest fitting unit. Exact halves round up."""
    return F.when(
        seconds.isNotNull(),
        F.when(seconds < MINUTE, F.format_string("%.1f seconds", seconds))
        .when(seconds < HOUR, F.format_string("%.1f minutes", seconds / MINUTE))
        .when(seconds < DAY, F.format_string("%.2f hours", seconds / HOUR))
        .otherwise(F.format_string("%.2f days", seconds / DAY)),
    )


def micros_since_epoch(ts: Column) -> Column:
    """Whole microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (ts - origin).cast("interval second").cast("decimal(20,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two zone-free timestamps, negative when they are swapped."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def range_span_seconds(first: Column, last: Column) -> Column:
    """Seconds from the start of the first day to the last second of the last day."""
    return (F.date_diff(last, first) * F.lit(DAY) + F.lit(DAY - 1)).cast("double")
