"""Number columns: cleaning of text, tolerant casts, output rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(value: Column) -> Column:
    """Digits, dot and minus of a text as DOUBLE; NULL when nothing numeric is left."""
    return F.regexp_replace(value.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def safe_double(value: Column) -> Column:
    """DOUBLE of a feed text; NULL for missing, '', 'None' and anything unparseable."""
    return F.when(~F.coalesce(value, F.lit("")).isin("", "None"), value.try_cast("double"))


def tidy(value: Column, digits: int) -> Column:
    """Rounded for output, negative zero turned into zero."""
    return F.round(value, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(a, b)


def half_up(value: Column, digits: int) -> Column:
    """Half-up rounding after float noise beyond ten digits is cut off."""
    return F.round(value.cast("decimal(20,10)"), digits).cast("double") + F.lit(0.0)
