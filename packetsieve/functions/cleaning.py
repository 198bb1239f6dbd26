"""Column expressions that coerce and fill packet columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MISSING_CATEGORY, MISSING_FLAGS, NULL_SPELLINGS


def null_spellings_to_null(c: Column) -> Column:
    """Null for every spelling of a missing value, else the text as written."""
    return F.when(~c.isin(*NULL_SPELLINGS), c)


def to_timestamp(c: Column, fmt: str | None = None) -> Column:
    """Zone-free timestamp; text that does not parse becomes null."""
    if fmt is None:
        return c.try_cast("timestamp_ntz")
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def to_number(c: Column, is_text: bool = True) -> Column:
    """Double; text that is no number becomes null, and so does NaN.

    The Spark cast also takes Java suffixes (``24d``) and hexadecimal floats,
    which are no numbers in a capture.
    """
    number = c.try_cast("double")
    if is_text:
        number = F.when(~c.rlike(r"[xX]|[0-9.][dDfF]\s*$"), number)
    return F.nanvl(number, F.lit(None).cast("double"))


def normalise_flags(c: Column) -> Column:
    """TCP flags as text, with one literal for null and empty."""
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(MISSING_FLAGS)).otherwise(
        c.cast("string")
    )


def fill_category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING_CATEGORY))


def fill_number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def refuse_infinite(first: Column, *others: Column) -> Column:
    """``first``, or a failed job when any of the numbers is infinite.

    No mean or distance is defined with an infinite value. One check for all
    columns keeps the generated method small enough for the JVM to compile.
    """
    largest = F.greatest(*[F.abs(c) for c in (first, *others)])
    return F.when(largest < F.lit(float("inf")), first).otherwise(
        F.raise_error(F.lit("infinite value in a numeric column")).cast("double")
    )
