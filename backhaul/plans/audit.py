"""Data-quality view of the returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_blank, non_blank

SAMPLE = 3
SAMPLE_COLUMNS = ("order_id", "asin", "return_date", "reason", "disposition")


def returns_diagnostic(returns: DataFrame) -> DataFrame:
    """One row: total, with_order_id, no_order_id, earliest and latest return date."""
    dated = F.when(non_blank("return_date"), F.col("return_date"))
    return returns.agg(
        F.count("*").alias("total"),
        F.count_if(non_blank("order_id")).alias("with_order_id"),
        F.count_if(is_blank("order_id")).alias("no_order_id"),
        F.min(dated).alias("earliest"),
        F.max(dated).alias("latest"),
    )


def returns_by_year(returns: DataFrame) -> DataFrame:
    """(year, records) of dated returns, oldest first; non-ISO dates under NULL."""
    dated = returns.filter(non_blank("return_date"))
    return dated.groupBy(F.col("return_y").alias("year")).agg(F.count("*").alias("records")).orderBy("year")


def diagnostic_samples(returns: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The first records (by id) without and with an order id."""

    def sample(found: DataFrame, kind: str) -> DataFrame:
        return found.orderBy("id").limit(rows).select(F.lit(kind).alias("sample"), *SAMPLE_COLUMNS)

    without = returns.filter(F.col("order_id").isNull() | (F.col("order_id") == ""))
    return sample(without, "no_order_id").unionAll(
        sample(returns.filter(non_blank("order_id")), "with_order_id")
    )


def returns_audit(returns: DataFrame) -> dict[str, DataFrame]:
    return {
        "diagnostic": returns_diagnostic(returns),
        "by_year": returns_by_year(returns),
        "samples": diagnostic_samples(returns),
    }
