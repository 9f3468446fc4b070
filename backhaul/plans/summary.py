"""The summary reports: totals, months, weeks and breakdowns.

Monthly and weekly order reports go through one daily rollup. It is summed by
(purchase date, week) with fixed-width buffers only, so it hashes and combines map
side whatever the table size; what is left is a few rows per day, and everything
after that (earliest dates as text, joins, sorts) is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import (
    high_rate_flag,
    label_month,
    label_underscores,
    non_blank,
    not_placeholder,
    safe_ratio_pct,
    year_month,
    year_text,
)
from ..operators.attribution import attribute_returns
from ..sources.staging import staged


def _status(name: str) -> Column:
    return F.col("order_status") == name


def _units(column: str = "quantity") -> Column:
    """Units of everything but trials; a row without status counts nothing."""
    return F.when(F.col("order_status") != schema.ON_TRIAL, F.col(column)).otherwise(0)


def _revenue() -> Column:
    price = F.col("item_price")
    return F.when(_status(schema.SHIPPED), price).otherwise(F.lit(0).cast(schema.MONEY))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# --- totals ---------------------------------------------------------------------


def order_stats(orders: DataFrame) -> DataFrame:
    """One row: orders, shipped, cancelled, revenue, units. Sums of nothing are NULL."""
    one = F.lit(1)
    return orders.agg(
        F.count("*").alias("total"),
        F.sum(F.when(_status(schema.SHIPPED), one).otherwise(0)).alias("shipped"),
        F.sum(F.when(_status(schema.CANCELLED), one).otherwise(0)).alias("cancelled"),
        F.sum(_revenue()).cast("double").alias("revenue"),
        F.sum(_units()).alias("units"),
    )


def return_stats(returns: DataFrame) -> DataFrame:
    return returns.agg(F.count("*").alias("total"), F.sum("quantity").alias("units"))


def dashboard_cards(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """One row: order units, revenue, return records and units, overall rate in percent.

    The overall rate relates all return units to all order units, without the join.
    """
    return dashboard_of(order_stats(orders), return_stats(returns))


def dashboard_of(sold: DataFrame, back: DataFrame) -> DataFrame:
    """The cards of the rows of ``order_stats`` and ``return_stats``."""
    nothing = F.lit(None)
    of_orders = sold.select(
        "units", "revenue", nothing.cast("bigint").alias("records"), nothing.cast("bigint").alias("r_units")
    )
    of_returns = back.select(
        nothing.cast("bigint"), nothing.cast("double"), "total", "units"
    )
    # Two one-row results laid side by side: stacked, then folded by max.
    both = of_orders.unionAll(of_returns).agg(
        F.coalesce(F.max("units"), F.lit(0)).alias("order_units"),
        F.max("revenue").alias("revenue"),
        F.coalesce(F.max("records"), F.lit(0)).alias("return_records"),
        F.coalesce(F.max("r_units"), F.lit(0)).alias("return_units"),
    )
    return both.withColumn("return_rate", safe_ratio_pct("return_units", "order_units", 1, 0.0))


# --- months and weeks --------------------------------------------------------------


def day_sums() -> list[Column]:
    """What orders are summed to, by day or whatever they are grouped by."""
    shipped = _status(schema.SHIPPED)
    return [
        F.sum(_units()).alias("order_units"),
        F.sum(_revenue()).alias("revenue"),
        _count(_status(schema.CANCELLED)).alias("cancelled"),
        _count(shipped).alias("shipped_orders"),
        F.sum(F.when(shipped, F.col("quantity")).otherwise(0)).alias("shipped_units"),
    ]


def daily_orders(orders: DataFrame) -> DataFrame:
    """Orders with a date, summed by (purchase date, week)."""
    return orders.filter(non_blank("purchase_date")).groupBy("purchase_date", "purchase_week").agg(*day_sums())


def monthly_orders(orders: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """(month, month_start, order_units, revenue, cancelled), oldest first.

    Dates that are no ISO dates form one group with a NULL month.
    """
    days = daily_orders(orders) if daily is None else daily
    return (
        days.groupBy(year_month("purchase_date").alias("month"))
        .agg(
            F.min("purchase_date").alias("month_start"),
            F.sum("order_units").alias("order_units"),
            F.sum("revenue").cast("double").alias("revenue"),
            F.sum("cancelled").alias("cancelled"),
        )
        .orderBy("month")
    )


def monthly_returns(orders: DataFrame, returns: DataFrame, match_blank_ids: bool = True) -> DataFrame:
    """(month, return_units): returned units by purchase month of the order."""
    dated = orders.filter(non_blank("purchase_date")).select(
        "amazon_order_id", F.col("purchase_ym").alias("month")
    )
    return attribute_returns(
        returns, dated, ["month"], {"return_units": F.col("quantity")}, match_blank_ids
    )


def monthly_summary(
    orders: DataFrame,
    returns: DataFrame,
    match_blank_ids: bool = True,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Months with units, revenue, cancellations, returned units, rate and flag."""
    months = monthly_orders(orders, daily)
    back = monthly_returns(orders, returns, match_blank_ids).withColumnRenamed("month", "r_month")
    # NULL matches NULL: returns of undated orders belong to the undated month.
    joined = months.join(back, F.col("month").eqNullSafe(F.col("r_month")), "left")
    units = F.coalesce("return_units", F.lit(0))
    return joined.select(
        "month",
        "month_start",
        "order_units",
        "revenue",
        "cancelled",
        units.alias("return_units"),
        safe_ratio_pct(units, "order_units", 1).alias("return_rate"),
        high_rate_flag(units, "order_units").alias("high_rate"),
    ).orderBy("month")


def weekly_returns(returns: DataFrame) -> DataFrame:
    """(year, week, returns): return records by return week."""
    return (
        returns.filter(non_blank("return_date"))
        .groupBy(F.col("return_y").alias("year"), F.col("return_week").alias("week"))
        .agg(F.count("*").alias("returns"))
    )


def weekly_orders(orders: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """(year, week, week_start, shipped_orders, units, revenue), by purchase week."""
    days = daily_orders(orders) if daily is None else daily
    return (
        days.filter(F.col("purchase_week").isNotNull())
        .groupBy(year_text("purchase_date").alias("year"), F.col("purchase_week").alias("week"))
        .agg(
            F.min("purchase_date").alias("week_start"),
            F.sum("shipped_orders").alias("shipped_orders"),
            F.sum("shipped_units").alias("units"),
            F.sum("revenue").cast("double").alias("revenue"),
        )
    )


def weekly_summary(orders: DataFrame, returns: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Weeks with shipped orders, units, revenue, return records, rate and flag."""
    return with_rates(weekly_orders(orders, daily), weekly_returns(returns))


def with_rates(weekly: DataFrame, returned: DataFrame) -> DataFrame:
    """Weeks of orders with the returns of the same week."""
    joined = weekly.join(returned, ["year", "week"], "left")
    back = F.coalesce("returns", F.lit(0))
    return joined.select(
        "year",
        "week",
        "week_start",
        "shipped_orders",
        "units",
        "revenue",
        back.alias("returns"),
        safe_ratio_pct(back, "shipped_orders", 1).alias("return_rate"),
        high_rate_flag(back, "shipped_orders").alias("high_rate"),
    ).orderBy("week_start", "year", "week")


def weekly_for_year(weekly: DataFrame, year: str | None = None) -> DataFrame:
    """The weeks of one year; all of them without a year."""
    return weekly.filter(F.col("year") == year) if year else weekly


def distinct_years(weekly: DataFrame) -> DataFrame:
    return weekly.select("year").distinct().orderBy(F.desc_nulls_last("year"))


def recent_months(monthly: DataFrame, newest: int = schema.CHART_MONTHS) -> DataFrame:
    """The newest months, oldest first."""
    return monthly.orderBy(F.desc_nulls_last("month")).limit(newest).orderBy("month")


def rate_series(monthly: DataFrame, newest: int = schema.CHART_MONTHS) -> DataFrame:
    """Chart points of the newest months: (month, label, order_units, return_units, rate)."""
    return recent_months(monthly, newest).select(
        "month",
        label_month("month").alias("label"),
        "order_units",
        "return_units",
        safe_ratio_pct("return_units", "order_units", 2, 0.0).alias("return_rate"),
    )


# --- breakdowns -----------------------------------------------------------------------


def _by(returns: DataFrame, column: str, wanted: Column, with_units: bool) -> DataFrame:
    measures = [F.count("*").alias("records")]
    if with_units:
        measures.append(F.sum("quantity").alias("units"))
    return returns.filter(wanted).groupBy(column).agg(*measures).orderBy(F.desc("records"), column)


def returns_by_reason(returns: DataFrame) -> DataFrame:
    return _by(returns, "reason", non_blank("reason"), True)


def returns_by_disposition(returns: DataFrame) -> DataFrame:
    return _by(returns, "disposition", non_blank("disposition"), False)


def returns_by_brand(returns: DataFrame, top: int = schema.TOP_BRANDS) -> DataFrame:
    return _by(returns, "brand", not_placeholder("brand"), True).limit(top)


def returns_by_gender(returns: DataFrame) -> DataFrame:
    return _by(returns, "gender", non_blank("gender"), False)


def top_reasons(returns: DataFrame, top: int = schema.TOP_REASONS) -> DataFrame:
    """(label, records) of the most frequent reasons."""
    best = returns_by_reason(returns).limit(top)
    return best.select("reason", label_underscores("reason").alias("label"), "records")


def breakdowns(returns: DataFrame) -> DataFrame:
    """(dimension, value, records, units) for reason, disposition, brand and gender.

    One scan and one aggregation serve all four; only the brands are cut to the top.
    """
    dimensions = ("reason", "disposition", "brand", "gender")
    exploded = returns.select(
        "quantity",
        F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])),
    )
    counts = (
        exploded.filter(non_blank("value"))
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("records"), F.sum("quantity").alias("units"))
    )
    is_brand = F.col("dimension") == "brand"
    brands = counts.filter(is_brand & not_placeholder("value"))
    top = brands.orderBy(F.desc("records"), "value").limit(schema.TOP_BRANDS)
    return counts.filter(~is_brand).unionAll(top).orderBy("dimension", F.desc("records"), "value")


@contextmanager
def summary(orders: DataFrame, returns: DataFrame) -> Iterator[dict[str, DataFrame]]:
    """Every part of the summary page, by name, to be read within the block.

    Months and weeks share the daily rollup: it is written (a few rows per day), so the
    order table is scanned once for both, and goes when the block ends.
    """
    with staged(daily_orders(orders)) as daily:
        yield {
            "order_stats": order_stats(orders),
            "return_stats": return_stats(returns),
            "monthly": monthly_summary(orders, returns, daily=daily),
            "weekly": weekly_summary(orders, returns, daily=daily),
            "by_reason": returns_by_reason(returns),
            "by_disposition": returns_by_disposition(returns),
            "by_brand": returns_by_brand(returns),
            "by_gender": returns_by_gender(returns),
        }
