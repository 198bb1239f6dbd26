from .cleaning import (
    fill_category,
    fill_number,
    normalise_flags,
    null_spellings_to_null,
    to_number,
    to_timestamp,
)
from .durations import duration_bucket, duration_text, elapsed_seconds, range_span_seconds
from .names import (
    capture_date,
    capture_file_name,
    date_field,
    model_folder_name,
    name_minutes,
    name_duration,
)

__all__ = [
    "capture_date",
    "capture_file_name",
    "date_field",
    "duration_bucket",
    "duration_text",
    "elapsed_seconds",
    "fill_category",
    "fill_number",
    "model_folder_name",
    "name_duration",
    "name_minutes",
    "normalise_flags",
    "null_spellings_to_null",
    "range_span_seconds",
    "to_number",
    "to_timestamp",
]
