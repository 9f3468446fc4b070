"""Sums that tables keep with every load, and the reports that read nothing else.

A load of any size becomes a row per day and a row per month and value. Reports of days, weeks,
months, values and pages add those rows up; a rewritten month is summed again by its rewrite. Only
what relates returns to their orders still reads both tables, as the sums of a day cannot tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import non_blank, not_placeholder
from ..operators.search import returns_page
from .summary import dashboard_of, day_sums, monthly_orders, weekly_orders, with_rates

DIMENSIONS = ("reason", "disposition", "brand", "gender", "return_month")


def order_days(orders: DataFrame) -> DataFrame:
    """Orders by day and week, those without a date too."""
    return orders.groupBy("purchase_ym", "purchase_date", "purchase_week").agg(F.count("*").alias("orders"), *day_sums())


def order_months(orders: DataFrame) -> DataFrame:
    """Month names as the sheets give them, with their first date."""
    days = orders.groupBy("purchase_ym", F.col("purchase_month").alias("value"), "purchase_date").agg(F.count("*").alias("records"))
    return days.groupBy("purchase_ym", "value").agg(F.sum("records").alias("records"), F.min("purchase_date").alias("earliest"))


def return_days(returns: DataFrame) -> DataFrame:
    """Return records and units by day."""
    return returns.groupBy("return_ym", "return_date", "return_y", "return_week").agg(
        F.count("*").alias("records"), F.sum("quantity").alias("units")
    )


def return_values(returns: DataFrame) -> DataFrame:
    """Records, units and first date of every value of the filters."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    days = returns.select("return_ym", "return_date", "quantity", F.inline(pairs)).filter(non_blank("value"))
    # Dates are texts, whose minimum Spark sorts for: days first, which combine before the shuffle
    days = days.groupBy("return_ym", "dimension", "value", "return_date").agg(
        F.count("*").alias("records"), F.sum("quantity").alias("units")
    )
    return days.groupBy("return_ym", "dimension", "value").agg(
        F.sum("records").alias("records"), F.sum("units").alias("units"), F.min("return_date").alias("earliest")
    )


ROLLUPS = {
    "orders": {"days": order_days, "months": order_months},
    "returns": {"days": return_days, "values": return_values},
}


def daily(tables) -> DataFrame:
    """What ``summary.daily_orders`` gives, and the number of orders."""
    days = tables.orders.rollup("days").filter(non_blank("purchase_date"))
    return _added(days, "purchase_date", "purchase_week")


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    measures = ("orders", "order_units", "revenue", "cancelled", "shipped_orders", "shipped_units")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def order_stats(tables) -> DataFrame:
    """One row, as ``summary.order_stats``: sums of nothing are NULL, counts 0."""
    sums = _added(tables.orders.rollup("days"))
    return sums.select(
        F.coalesce("orders", F.lit(0)).alias("total"),
        F.col("shipped_orders").alias("shipped"),
        "cancelled",
        F.col("revenue").cast("double").alias("revenue"),
        F.col("order_units").alias("units"),
    )


def return_stats(tables) -> DataFrame:
    days = tables.returns.rollup("days")
    return days.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"), F.sum("units").alias("units"))


def dashboard_cards(tables) -> DataFrame:
    return dashboard_of(order_stats(tables), return_stats(tables))


def monthly(tables) -> DataFrame:
    return monthly_orders(tables.orders.read(), daily(tables))


def weekly_returns(tables) -> DataFrame:
    days = tables.returns.rollup("days").filter(non_blank("return_date"))
    return days.groupBy(F.col("return_y").alias("year"), F.col("return_week").alias("week")).agg(F.sum("records").alias("returns"))


def weekly_summary(tables) -> DataFrame:
    return with_rates(weekly_orders(tables.orders.read(), daily(tables)), weekly_returns(tables))


def _values(tables) -> DataFrame:
    values = tables.returns.rollup("values").groupBy("dimension", "value")
    return values.agg(F.sum("records").alias("records"), F.sum("units").alias("units"), F.min("earliest").alias("earliest"))


def breakdowns(tables) -> DataFrame:
    """As ``summary.breakdowns``."""
    counts = _values(tables).filter(F.col("dimension") != "return_month").drop("earliest")
    is_brand = F.col("dimension") == "brand"
    top = counts.filter(is_brand & not_placeholder("value")).orderBy(F.desc("records"), "value").limit(schema.TOP_BRANDS)
    return counts.filter(~is_brand).unionAll(top).orderBy("dimension", F.desc("records"), "value")


def filter_options(tables) -> DataFrame:
    """As ``search.filter_options``. A value whose last record has gone is not among them."""
    wanted = F.col("dimension").isin("reason", "disposition", "return_month") | (
        (F.col("dimension") == "brand") & not_placeholder("value")
    )
    earliest = F.when(F.col("dimension") == "return_month", F.col("earliest"))
    values = _values(tables).filter(wanted).select(F.col("dimension").alias("facet"), "value", earliest.alias("earliest"))
    bought = tables.orders.rollup("months").filter(non_blank("value")).groupBy("value").agg(F.min("earliest").alias("earliest"))
    bought = bought.select(F.lit("purchase_month").alias("facet"), "value", "earliest")
    return values.unionByName(bought).orderBy("facet", F.desc_nulls_last("earliest"), "value")


def page(tables, number: int = 1, page_size: int = schema.PAGE_SIZE, **constraints: str) -> DataFrame:
    """A page of the returns. Without constraints the counts of dates are those kept with the
    loads, so only the months and dates that hold the page are read."""
    days = tables.returns.rollup("days").select("return_ym", "return_date", F.col("records").alias("n"))
    return returns_page(
        tables.returns.read(), number, page_size, dates=None if any(constraints.values()) else days, **constraints
    )
