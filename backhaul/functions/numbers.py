"""Number expressions: lenient parsing, shortest text, rates, display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from .text import as_column

# What a missing number looks like in labels and exports.
MISSING = "—"

PLAIN_NUMBER = r"^-?[0-9]+\.?[0-9]*$"


def parse_num(cell: Column | str) -> Column:
    """Lenient number: drop all but digits, dot and minus, read the longest prefix.

    ``$1,234.50`` -> 1234.5, ``(7)`` -> 7, ``1-2`` -> 1, ``abc`` -> NULL.
    """
    cell = as_column(cell)
    kept = F.regexp_replace(cell, r"[^0-9.\-]", "")
    prefix = F.regexp_extract(kept, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    # Plain numbers and empty cells, which most are, need neither pattern above.
    return F.when(cell.rlike(PLAIN_NUMBER), cell.try_cast("double")).when(
        cell != "", prefix.try_cast("double")
    )


def js_number_text(number: Column | str) -> Column:
    """Shortest decimal text of a number: 19.0 -> ``19``, 19.99 -> ``19.99``."""
    fixed = as_column(number).try_cast("decimal(38,10)").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "")


def order_quantity(number: Column | str) -> Column:
    """A missing order quantity is 0."""
    return F.coalesce(as_column(number), F.lit(0))


def return_quantity(number: Column | str) -> Column:
    """A missing *or zero* return quantity is 1."""
    value = as_column(number)
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(1)).otherwise(value)


def whole_units(number: Column | str) -> Column:
    """Tables hold whole units: a fraction is rounded, halves away from zero.

    To be applied after a default, so that 0.5 is a quantity and no missing one.
    """
    return F.round(as_column(number), 0).try_cast("bigint")


def safe_ratio_pct(
    num: Column | str, den: Column | str, places: int = 1, missing: float | None = None
) -> Column:
    """``num / den`` in percent; ``missing`` where there is no denominator."""
    num, den = as_column(num), as_column(den)
    rate = F.round(num.cast("double") * 100.0 / den.cast("double"), places)
    return F.when(den > 0, rate).otherwise(F.lit(missing).cast("double"))


def high_rate_flag(num: Column | str, den: Column | str) -> Column:
    """Rate above 10 %; false where there is no denominator."""
    num, den = as_column(num), as_column(den)
    rate = num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
    return F.coalesce((den > 0) & (rate > schema.HIGH_RATE), F.lit(False))


def percent_text(num: Column | str, den: Column | str) -> Column:
    """Export form of a rate: two decimals and a percent sign, ``0%`` without orders."""
    rate = safe_ratio_pct(num, den, 2)
    return F.when(rate.isNull(), F.lit("0%")).otherwise(F.format_string("%.2f%%", rate))


def money_label(amount: Column | str) -> Column:
    text = F.concat(F.lit("$"), F.format_number(F.round(as_column(amount), 2), 2))
    return F.coalesce(text, F.lit(MISSING))


def count_label(count: Column | str) -> Column:
    return F.coalesce(F.format_number(as_column(count), 0), F.lit(MISSING))


def page_count(total: Column | str, page_size: int = schema.PAGE_SIZE) -> Column:
    return F.ceil(as_column(total) / F.lit(page_size)).cast("bigint")
