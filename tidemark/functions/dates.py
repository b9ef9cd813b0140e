"""Month texts to dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import lookup, matched
from tidemark.functions.vocab import MONTHS

MONTH_NUMBERS = {m.lower(): i + 1 for i, m in enumerate(MONTHS)} | {
    m[:3].lower(): i + 1 for i, m in enumerate(MONTHS)
}


def _first_of(year: Column, month: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                       F.lit("01"))
    return F.when(year.isNotNull() & month.isNotNull() & month.between(1, 12), F.to_date(text))


def parse_month(text: Column) -> Column:
    """First of the month for 'Month YYYY', 'Mon-YY', 'Mon YYYY' and 'MM/YYYY'; else NULL.

    Two-digit years below 50 are 20YY, the others 19YY.
    """
    clean = F.trim(text)
    worded = r"^([A-Za-z]+)[\s\-]+(\d{4}|\d{2})$"
    month = lookup(F.lower(matched(clean, worded, 1)), MONTH_NUMBERS)
    year = matched(clean, worded, 2).try_cast("int")
    year = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    numeric = r"^(\d{1,2})[/\-](\d{4})$"
    return F.coalesce(
        _first_of(year, month),
        _first_of(matched(clean, numeric, 2).try_cast("int"), matched(clean, numeric, 1).try_cast("int")),
    )


def month_name(date: Column) -> Column:
    """'January 2025' of a date."""
    return F.date_format(date, "MMMM yyyy")
