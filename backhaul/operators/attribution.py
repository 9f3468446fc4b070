"""Attribute returns to the orders they came from.

``returns JOIN orders`` on the order id is many-to-many: a return counts once per
order line that shares its id, and a blank id matches every blank id. Joined row by
row, ids with m returns and n lines give m * n rows. Both sides are therefore summed
per id first, which combines before the shuffle: sum(quantity) over the join equals
the sum of (units per id) * (lines per id).

Units times lines of one id, blank ids above all, can pass the range of BIGINT. Units,
products and their sums are therefore DECIMAL(38,0), which is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import non_blank

ORDER_ID = "_order_id"
UNITS = "decimal(20,0)"  # of one row or id: all that BIGINT holds
EXACT = "decimal(38,0)"


def total_units(units: Column, lines: Column) -> Column:
    """Sum of units per id times lines per id."""
    return F.sum((units * lines.cast(UNITS)).cast(EXACT))


def units_per_order(
    returns: DataFrame,
    measures: Mapping[str, Column],
    keys: Sequence[str] = (),
    match_blank_ids: bool = True,
) -> DataFrame:
    """Sums of the measures per order id (and ``keys``)."""
    named = returns.withColumnRenamed("order_id", ORDER_ID)
    named = named.filter(F.col(ORDER_ID).isNotNull() if match_blank_ids else non_blank(ORDER_ID))
    sums = [F.sum(m.cast(UNITS)).alias(n) for n, m in measures.items()]
    return named.groupBy(ORDER_ID, *keys).agg(*sums)


def lines_per_order(
    orders: DataFrame, lines: Mapping[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Weighted line counts per order id (and ``keys``)."""
    named = orders.withColumnRenamed("amazon_order_id", ORDER_ID)
    named = named.filter(F.col(ORDER_ID).isNotNull())
    return named.groupBy(ORDER_ID, *keys).agg(*[F.sum(c).alias(n) for n, c in lines.items()])


def attribute_returns(
    returns: DataFrame,
    orders: DataFrame,
    order_keys: Sequence[str],
    measures: Mapping[str, Column],
    match_blank_ids: bool = True,
) -> DataFrame:
    """Sums of return measures by attributes of the order, over the many-to-many join."""
    units = units_per_order(returns, measures, match_blank_ids=match_blank_ids)
    lines = lines_per_order(orders, {"_lines": F.lit(1)}, order_keys)
    return (
        units.join(lines, ORDER_ID)
        .groupBy(*order_keys)
        .agg(*[total_units(F.col(n), F.col("_lines")).alias(n) for n in measures])
    )
