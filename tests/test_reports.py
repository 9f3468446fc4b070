import datetime as dt

import pytest
from pyspark.sql import functions as F

from backhaul import plans, schema
from backhaul.session import scratch_root
from backhaul.sources import list_files, star


@pytest.fixture(scope="module")
def orders(spark, folder):
    return star.order_lines(spark, folder)


@pytest.fixture(scope="module")
def returns(spark, folder):
    return star.return_records(spark, folder)


def test_periods_reach_over_gaps(spark):
    orders = spark.createDataFrame(
        [("2024-05-01", "o1"), ("2024-03-01", "o2"), ("2023-11-01", "o3"), ("2023-01-01", "o4"), ("x", "o5")],
        "purchase_date STRING, amazon_order_id STRING",
    ).select(
        "*",
        F.regexp_extract("purchase_date", "^([0-9]{4}-[0-9]{2})", 1).alias("ym"),
        F.lit("Shipped").alias("order_status"),
        F.lit(2).cast("bigint").alias("quantity"),
    ).withColumn("purchase_ym", F.nullif("ym", F.lit("")))
    months = plans.period_months(orders, dt.date(2024, 5, 20)).collect()
    by_period = {p: [m["month"] for m in months if m["period"] == p] for p in schema.PERIODS}
    assert sorted(by_period["last_month"]) == ["2024-03"]
    assert sorted(by_period["last_3_months"]) == ["2023-01", "2023-11", "2024-03"]
    units = {r["period"]: r["orders_units"] for r in plans.period_order_units(orders, dt.date(2024, 5, 20)).collect()}
    assert units == {"last_month": 2, "last_3_months": 6, "last_12_months": 6}


def test_no_months_give_zeros(orders, returns):
    rows = plans.period_stats(orders, returns, dt.date(1990, 1, 1)).collect()
    assert [tuple(r)[2:] for r in rows] == [(0, 0, 0, 0)] * 3
    assert plans.period_dispositions(orders, returns, dt.date(1990, 1, 1)).count() == 0


def test_period_totals_grow_with_the_period(orders, returns):
    rows = plans.period_stats(orders, returns, star.AS_OF).collect()
    assert [r["months"] for r in rows] == [1, 3, 12]
    for a, b in zip(rows, rows[1:]):
        assert a["orders_units"] <= b["orders_units"] and a["returns_total"] <= b["returns_total"]
    assert all(r["sellable"] + r["unsellable"] <= r["returns_total"] for r in rows)


def test_comparison_table_order(orders, returns):
    rows = plans.period_table(orders, returns, star.AS_OF).collect()
    positions = [r["position"] for r in rows]
    shares = [r for r in rows if r["disposition"]]
    assert positions[:6] == [1, 2, 3, 4, 5, 6] and positions[-3:] == [10, 11, 12]
    units = [r["last_12_months"] for r in shares if r["metric"] == "units"]
    assert units == sorted(units, reverse=True)
    names = [r["disposition"] for r in plans.period_disposition_names(orders, returns, star.AS_OF).collect()]
    assert [r["disposition"] for r in shares if r["metric"] == "units"] == names


def test_months_are_sorted_with_the_undated_first(orders, returns):
    months = [r["month"] for r in plans.monthly_summary(orders, returns).collect()]
    assert months[0] is None and months[1:] == sorted(months[1:])


def test_recent_months_leave_the_undated_out(orders, returns):
    monthly = plans.monthly_summary(orders, returns)
    recent = [r["month"] for r in plans.recent_months(monthly).collect()]
    assert len(recent) == 18 and None not in recent and recent == sorted(recent)


def test_empty_tables(spark):
    orders = spark.createDataFrame([], schema.ORDERS)
    returns = spark.createDataFrame([], schema.RETURNS)
    assert tuple(plans.order_stats(orders).first()) == (0, None, None, None, None)
    cards = plans.dashboard_cards(orders, returns).first()
    assert (cards["order_units"], cards["return_units"], cards["return_rate"]) == (0, 0, 0.0)
    assert plans.monthly_summary(orders, returns).count() == 0
    assert plans.weekly_summary(orders, returns).count() == 0
    assert plans.breakdowns(returns).count() == 0


def test_money_sums_are_null_only_without_any_price(spark):
    orders = spark.createDataFrame(
        [("2024-01-01", 1, "Shipped", 1, None)],
        "purchase_date STRING, purchase_week INT, order_status STRING, quantity BIGINT, item_price DECIMAL(18,2)",
    )
    row = plans.monthly_orders(orders).first()
    assert row["revenue"] is None and row["order_units"] == 1


def test_summary_has_every_part(spark, orders, returns):
    def copies():
        return [n for n in list_files(spark, scratch_root(spark)) if n.startswith("staged-")]

    with plans.summary(orders, returns) as parts:
        assert set(parts) == {
            "order_stats", "return_stats", "monthly", "weekly",
            "by_reason", "by_disposition", "by_brand", "by_gender",
        }
        whole = parts["monthly"].agg(F.sum("order_units")).first()[0]
        assert whole == plans.monthly_orders(orders).agg(F.sum("order_units")).first()[0]
        assert parts["by_brand"].count() <= schema.TOP_BRANDS
        assert len(copies()) == 1
    assert copies() == []


def test_weekly_year_filter(orders, returns):
    weekly = plans.weekly_summary(orders, returns)
    years = [r["year"] for r in plans.distinct_years(weekly).collect()]
    assert years == sorted(years, reverse=True)
    assert plans.weekly_for_year(weekly).count() == sum(plans.weekly_for_year(weekly, y).count() for y in years)
