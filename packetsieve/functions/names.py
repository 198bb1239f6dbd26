"""What a capture's file name and a model's name say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NO_DURATION
from .durations import duration_bucket

# The date form in a file name and the capture-length part.
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MINUTES_PATTERN = r"\(([0-9.]+)_minutes\)"


def capture_file_name(path: Column) -> Column:
    """Base name of a capture, which is a CSV file or a folder of part files named like one.

    A folder that Spark wrote for one value of a column is named ``column=value``.
    """
    name = F.regexp_extract(path, r"(?:/[^/=]+=|/|^)([^/]+\.csv)(?:/part-[^/]*)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def date_field(name: Column, keep_ending: bool = False) -> Column:
    """Second ``_`` field of a file name, null when there is none.

    Training splits the whole name, scoring the name without its ending; the
    two differ only where the date is the last field.
    """
    if not keep_ending:
        name = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.try_element_at(F.split(name, "_"), F.lit(2))


def capture_date(name: Column, keep_ending: bool = False) -> Column:
    """Date in a file name, null unless written as YYYY-MM-DD."""
    field = date_field(name, keep_ending)
    return F.when(field.rlike(DATE_PATTERN), field.try_cast("date"))


def name_minutes(name: Column) -> Column:
    """Capture length in minutes from ``(M_minutes)``, null when absent or no number."""
    return F.nullif(F.regexp_extract(name, MINUTES_PATTERN, 1), F.lit("")).try_cast("double")


def name_duration(name: Column) -> tuple[Column, Column, Column]:
    """Seconds, text and bucket of the capture length in a file name."""
    minutes = name_minutes(name)
    seconds = minutes * F.lit(60.0)
    text = F.when(minutes.isNotNull(), F.format_string("%.1f minutes", minutes)).otherwise(
        F.lit(NO_DURATION)
    )
    return seconds, text, duration_bucket(seconds)


def model_folder_name(start: Column, end: Column) -> Column:
    """Name of the model trained on a date range, either end open when null."""
    first, last = start.cast("string"), end.cast("string")
    return (
        F.when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit("_"), last))
        .when(first.isNotNull(), F.concat(first, F.lit("_to_latest")))
        .when(last.isNotNull(), F.concat(F.lit("from_earliest_"), last))
        .otherwise(F.lit("global"))
    )
