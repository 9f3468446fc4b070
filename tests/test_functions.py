import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from backhaul import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    "cell, number",
    [
        ("$1,234.50", 1234.5),
        ("", None),
        (None, None),
        ("--5", None),
        ("1-2", 1.0),
        ("1.2.3", 1.2),
        ("-.5", -0.5),
        ("5.", 5.0),
        ("(7)", 7.0),
        ("abc", None),
        ("1e5", 15.0),
        ("-", None),
        (".", None),
        ("USD 10", 10.0),
    ],
)
def test_parse_num(spark, cell, number):
    assert one(spark, fn.parse_num(text(cell))) == number


@pytest.mark.parametrize(
    "cell, parsed",
    [
        ("2024-01-05T10:00:00+00:00", "2024-01-05"),
        (" 2024-01-05 ", "2024-01-05"),
        ("5/1/2024", "5/1/2024"),
        ("", None),
        (None, None),
        ("  ", ""),
        (" 2024-01-05\t", "2024-01-05"),
    ],
)
def test_parse_date_text(spark, cell, parsed):
    assert one(spark, fn.parse_date_text(text(cell))) == parsed


@pytest.mark.parametrize(
    "serial, parsed",
    [
        (45296.75, "2024-01-05"),
        (1.0, "1900-01-01"),
        (59.0, "1900-02-28"),
        (61.0, "1900-03-01"),
        (1e12, None),
    ],
)
def test_parse_date_serial(spark, serial, parsed):
    assert one(spark, fn.parse_date_serial(F.lit(serial))) == parsed


@pytest.mark.parametrize(
    "cell, parsed",
    [
        ("45296.75", "2024-01-05"),
        ("0", None),
        ("0.00", None),
        ("20240105", "20240105"),
        ("5/1/2024", "5/1/2024"),
    ],
)
def test_parse_date_of_a_sheet_cell(spark, cell, parsed):
    assert one(spark, fn.parse_date(text(cell))) == parsed


@pytest.mark.parametrize(
    "date, week",
    [
        ("1995-01-01", 1),
        ("1995-01-07", 1),
        ("1995-01-08", 2),
        ("2000-12-31", 54),
        ("5/1/2024", None),
        ("2024", None),
        ("2023-02-30", None),
        ("", None),
        (None, None),
    ],
)
def test_week_number(spark, date, week):
    assert one(spark, fn.week_number(text(date))) == week


@pytest.mark.parametrize(
    "number, shown", [(19.0, "19"), (19.99, "19.99"), (100.0, "100"), (1e7, "10000000"), (0.5, "0.5")]
)
def test_js_number_text(spark, number, shown):
    assert one(spark, fn.js_number_text(F.lit(number))) == shown


def test_missing_quantities(spark):
    nothing = F.lit(None).cast("bigint")
    assert one(spark, fn.order_quantity(nothing)) == 0
    assert one(spark, fn.return_quantity(nothing)) == 1
    assert one(spark, fn.return_quantity(F.lit(0))) == 1
    assert one(spark, fn.return_quantity(F.lit(3))) == 3


@pytest.mark.parametrize(
    "given, date, month",
    [("", "2024-01-05", "January 2024"), ("Feb", "2024-01-05", "Feb"), (" ", "5/1/2024", ""), ("", None, "")],
)
def test_derive_return_month(spark, given, date, month):
    assert one(spark, fn.derive_return_month(text(given), text(date))) == month


def test_derive_return_year(spark):
    assert one(spark, fn.derive_return_year(text(""), text("2024-01-05"))) == "2024"
    assert one(spark, fn.derive_return_year(text("FY23"), text("2024-01-05"))) == "FY23"


@pytest.mark.parametrize(
    "date, ym, year",
    [
        ("2024-01-05", "2024-01", "2024"),
        ("2024-13-05", None, None),
        ("5/1/2024", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_year_month(spark, date, ym, year):
    assert one(spark, fn.year_month(text(date))) == ym
    assert one(spark, fn.year_text(text(date))) == year


def test_first_nonblank_tests_before_trimming(spark):
    assert one(spark, fn.first_nonblank(text(""), text(" b "), text("c"))) == "b"
    assert one(spark, fn.first_nonblank(text(" "), text("b"))) == ""
    assert one(spark, fn.first_nonblank(text(None))) == ""


def test_row_hash_keeps_the_place_of_missing_parts(spark):
    with_null = one(spark, fn.row_hash(text("a"), text(None), text("b")))
    with_blank = one(spark, fn.row_hash(text("a"), text(""), text("b")))
    assert with_null == with_blank == hashlib.md5(b"a||b").hexdigest()
    assert with_null != one(spark, fn.row_hash(text("a"), text("b")))


def test_rates(spark):
    assert one(spark, fn.safe_ratio_pct(F.lit(1), F.lit(3))) == 33.3
    assert one(spark, fn.safe_ratio_pct(F.lit(1), F.lit(3), 2)) == 33.33
    assert one(spark, fn.safe_ratio_pct(F.lit(1), F.lit(0))) is None
    assert one(spark, fn.safe_ratio_pct(F.lit(1), F.lit(0), 1, 0.0)) == 0.0
    assert one(spark, fn.high_rate_flag(F.lit(11), F.lit(100))) is True
    assert one(spark, fn.high_rate_flag(F.lit(10), F.lit(100))) is False
    assert one(spark, fn.high_rate_flag(F.lit(10), F.lit(0))) is False
    assert one(spark, fn.percent_text(F.lit(1), F.lit(3))) == "33.33%"
    assert one(spark, fn.percent_text(F.lit(1), F.lit(0))) == "0%"


def test_labels(spark):
    assert one(spark, fn.label_disposition(text("CUSTOMER_DAMAGED_x"))) == "CUSTOMER DAMAGED X"
    assert one(spark, fn.label_underscores(text("NOT_AS_DESCRIBED"))) == "NOT AS DESCRIBED"
    assert one(spark, fn.label_month(text("2024-01"))) == "Jan '24"
    assert one(spark, fn.label_month(text(None))) == ""
    assert one(spark, fn.money_label(F.lit(1234.5))) == "$1,234.50"
    assert one(spark, fn.money_label(F.lit(None).cast("double"))) == "—"
    assert one(spark, fn.count_label(F.lit(1234567))) == "1,234,567"
    assert one(spark, fn.page_count(F.lit(101))) == 3
    assert one(spark, fn.current_ym(dt.date(2024, 5, 17))) == "2024-05"
