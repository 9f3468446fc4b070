"""CSV forms of the monthly and weekly reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import percent_text
from .summary import weekly_for_year


def _two_places(amount: str) -> Column:
    return F.col(amount).cast("decimal(28,2)").cast("string")


def export_monthly(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        F.col("month").alias("Month"),
        F.col("order_units").alias("Shipped Orders"),
        F.col("order_units").alias("Units Sold"),
        _two_places("revenue").alias("Revenue"),
        F.col("cancelled").alias("Cancelled"),
        F.col("return_units").alias("Returns"),
        F.col("return_units").alias("Return Units"),
        percent_text("return_units", "order_units").alias("Return Rate"),
    )


def export_weekly(weekly: DataFrame, year: str | None = None) -> DataFrame:
    return weekly_for_year(weekly, year).select(
        F.col("year").alias("Year"),
        F.col("week").alias("Week"),
        F.col("week_start").alias("Week Start"),
        F.col("shipped_orders").alias("Shipped Orders"),
        F.col("units").alias("Units"),
        _two_places("revenue").alias("Revenue"),
        F.col("returns").alias("Returns"),
        percent_text("returns", "shipped_orders").alias("Return Rate"),
    )
