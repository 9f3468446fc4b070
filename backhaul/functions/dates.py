"""Date expressions. Dates stay text (``yyyy-MM-dd``); other text passes through."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, trimmed

ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
# With month and day in range, so that garbage gives no month.
ISO_VALID = "^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
PLAIN_NUMBER = r"^[0-9]+(?:\.[0-9]+)?$"

# The largest spreadsheet day serial (9999-12-31), and the serial of
# the 1900-02-29 that never was, after which the count is one day ahead.
LAST_SERIAL = 2958465
LEAP_BUG_SERIAL = 60


def iso_date(text: Column | str) -> Column:
    """DATE of the ISO prefix, NULL for anything else (also ``2023-02-30``)."""
    text = as_column(text)
    # The pattern guards the cast, which would also take ``2024`` or ``2024-1``.
    return F.when(text.rlike(ISO_DATE), F.left(text, F.lit(10)).try_cast("date"))


def parse_date_text(cell: Column | str) -> Column:
    """ISO prefix cut to ten characters; other text verbatim but trimmed."""
    cell = as_column(cell)
    text = trimmed(cell)
    return F.when(
        cell != "", F.when(text.rlike(ISO_DATE), F.left(text, F.lit(10))).otherwise(text)
    )


def parse_date_serial(serial: Column | str) -> Column:
    """Spreadsheet day serial to ``yyyy-MM-dd``; the fraction (time of day) is dropped."""
    serial = as_column(serial).cast("double")
    in_range = (serial >= 1) & (serial < LAST_SERIAL + 1)
    days = F.when(in_range, F.floor(serial)).cast("int")
    origin = F.when(serial > LEAP_BUG_SERIAL, F.lit(dt.date(1899, 12, 30))).otherwise(
        F.lit(dt.date(1899, 12, 31))
    )
    return F.date_add(origin, days).cast("string")


def parse_date(cell: Column | str) -> Column:
    """Cell of a raw sheet: a plain number is a day serial (0 is missing), else text."""
    cell = as_column(cell)
    serial = cell.try_cast("double")
    of_number = F.when(serial != 0, F.coalesce(parse_date_serial(serial), cell))
    return (
        F.when(cell.rlike(ISO_DATE), F.left(cell, F.lit(10)))
        .when(cell.rlike(PLAIN_NUMBER), of_number)
        .otherwise(parse_date_text(cell))
    )


def week_of(day: Column | str) -> Column:
    """Sunday-start week of a DATE, week 1 holds January 1st, range 1 to 54."""
    day = as_column(day)
    offset = F.dayofweek(F.trunc(day, "YEAR")) - 1
    return F.ceil((F.dayofyear(day) + offset) / F.lit(7)).cast("int")


def week_number(text: Column | str) -> Column:
    """Week of an ISO date text, NULL for anything else."""
    return week_of(iso_date(text))


def year_month(text: Column | str) -> Column:
    """``yyyy-MM`` of an ISO date text, else NULL."""
    text = as_column(text)
    return F.when(text.rlike(ISO_VALID), F.left(text, F.lit(7)))


def year_text(text: Column | str) -> Column:
    """``yyyy`` of an ISO date text, else NULL."""
    text = as_column(text)
    return F.when(text.rlike(ISO_VALID), F.left(text, F.lit(4)))


def derive_return_month(explicit: Column | str, return_date: Column | str) -> Column:
    """The explicit month if given, else ``January 2024`` from the date, else ``''``."""
    return _explicit_or(explicit, F.date_format(iso_date(return_date), "MMMM yyyy"))


def derive_return_year(explicit: Column | str, return_date: Column | str) -> Column:
    return _explicit_or(explicit, F.date_format(iso_date(return_date), "yyyy"))


def _explicit_or(explicit: Column | str, derived: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(explicit), F.lit("")), derived, F.lit(""))


def current_ym(as_of: dt.date | Column) -> Column:
    """``yyyy-MM`` of the reporting day. Callers pass the day; no clock in here."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.date_format(day, "yyyy-MM")
