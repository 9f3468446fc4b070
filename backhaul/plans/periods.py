"""Trailing periods: the last 1, 3 and 12 months that have orders.

A period is made of months present in the orders, strictly before the reporting
month, so a gap reaches further back. Returns count for the purchase month of their
order. All three periods come out of one pass: the months are ranked once and every
order line counts for each period its month belongs to.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import current_ym, label_disposition, non_blank, safe_ratio_pct
from ..operators.attribution import EXACT, ORDER_ID, lines_per_order, total_units, units_per_order

RANK = "month_rank"
LONGEST = max(schema.PERIODS.values())
FIRST_SHARE = 7  # table position of the rows that repeat per disposition


def ranked_months(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """(purchase_ym, order_units, month_rank) of the latest twelve months, newest first.

    Twelve rows at most, and every period report needs them twice. They are fetched when
    a report is built, and are literals in it from then on.
    """
    units = F.when(F.col("order_status") != schema.ON_TRIAL, F.col("quantity"))
    months = (
        orders.filter(non_blank("purchase_date") & (F.col("purchase_ym") < current_ym(as_of)))
        .groupBy("purchase_ym")
        .agg(F.sum(units).alias("order_units"))
    )
    latest = months.orderBy(F.desc("purchase_ym")).limit(LONGEST).collect()
    ranked = [(*row, rank) for rank, row in enumerate(latest, 1)]
    return orders.sparkSession.createDataFrame(ranked, f"purchase_ym string, order_units bigint, {RANK} int")


def period_months(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """(period, months, month, month_rank): the months each period consists of."""
    months = ranked_months(orders, as_of)
    return months.select(F.col("purchase_ym").alias("month"), RANK, F.inline(_periods())).filter(
        F.col(RANK) <= F.col("months")
    ).select("period", "months", "month", RANK)


def _periods() -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("period"), F.lit(n).alias("months"))
            for name, n in schema.PERIODS.items()
        ]
    )


def _per_period(row: DataFrame, measures: list[str], keys: Sequence[str] = ()) -> DataFrame:
    """Columns ``<measure>_<months>`` of each row to one row per period."""
    structs = [
        F.struct(
            F.lit(name).alias("period"),
            F.lit(n).alias("months"),
            *[F.col(f"{m}_{n}").alias(m) for m in measures],
        )
        for name, n in schema.PERIODS.items()
    ]
    return row.select(*keys, F.inline(F.array(*structs)))


def period_order_units(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """(period, months, orders_units); periods without months count 0."""
    return _order_units(ranked_months(orders, as_of))


def _order_units(months: DataFrame) -> DataFrame:
    sums = [
        F.coalesce(F.sum(F.when(F.col(RANK) <= n, F.col("order_units"))), F.lit(0)).alias(f"orders_units_{n}")
        for n in schema.PERIODS.values()
    ]
    return _per_period(months.agg(*sums), ["orders_units"])


def _returned(
    orders: DataFrame, returns: DataFrame, months: DataFrame, match_blank_ids: bool = True
) -> DataFrame:
    """Units and matches per disposition and period, one row per disposition.

    The twelve ranked months prune month folders, and are broadcast onto the orders. Each order id then carries its line counts of all periods.
    """
    ranks = F.broadcast(months.select("purchase_ym", RANK))
    names = [r["purchase_ym"] for r in months.select("purchase_ym").collect()]  # literals by now
    inside = orders.select("amazon_order_id", "purchase_ym").filter(F.col("purchase_ym").isin(names))
    inside = inside.join(ranks, "purchase_ym")
    lines = lines_per_order(
        inside,
        {f"lines_{n}": (F.col(RANK) <= n).cast("bigint") for n in schema.PERIODS.values()},
    )
    units = units_per_order(returns, {"units": F.col("quantity")}, ["disposition"], match_blank_ids)
    sums = []
    for n in schema.PERIODS.values():
        sums.append(total_units(F.col("units"), F.col(f"lines_{n}")).alias(f"units_{n}"))
        sums.append(F.max(F.col(f"lines_{n}") > 0).alias(f"seen_{n}"))
    return units.join(lines, ORDER_ID).groupBy("disposition").agg(*sums)


def _is_unsellable() -> Column:
    return ~F.col("disposition").isin("", schema.SELLABLE)


def period_returns(
    orders: DataFrame, returns: DataFrame, as_of: dt.date, match_blank_ids: bool = True
) -> DataFrame:
    """(period, months, returns_total, sellable, unsellable) in units.

    Blank dispositions count in the total only.
    """
    return _totals(_returned(orders, returns, ranked_months(orders, as_of), match_blank_ids))


def _totals(returned: DataFrame) -> DataFrame:
    sums = []
    for n in schema.PERIODS.values():
        units = F.col(f"units_{n}")
        for measure, value in (
            ("returns_total", units),
            ("sellable", F.when(F.col("disposition") == schema.SELLABLE, units)),
            ("unsellable", F.when(_is_unsellable(), units)),
        ):
            total = F.coalesce(F.sum(value), F.lit(0)).cast(EXACT)
            sums.append(total.alias(f"{measure}_{n}"))
    return _per_period(returned.agg(*sums), ["returns_total", "sellable", "unsellable"])


def period_dispositions(
    orders: DataFrame, returns: DataFrame, as_of: dt.date, match_blank_ids: bool = True
) -> DataFrame:
    """(period, months, disposition, units) of unsellable returns, most units first."""
    returned = _returned(orders, returns, ranked_months(orders, as_of), match_blank_ids)
    return _dispositions(returned).orderBy("months", F.desc("units"), "disposition")


def _dispositions(returned: DataFrame, weight: str | None = None) -> DataFrame:
    """Unsellable dispositions per period; ``weight`` names a column to carry along."""
    unsellable = returned.filter(_is_unsellable())
    kept = ["disposition"]
    if weight is not None:
        unsellable = unsellable.withColumn("weight", F.col(weight))
        kept.append("weight")
    rows = _per_period(unsellable, ["units", "seen"], kept)
    return rows.filter("seen").select("period", "months", *kept, "units")


def period_disposition_names(
    orders: DataFrame, returns: DataFrame, as_of: dt.date, match_blank_ids: bool = True
) -> DataFrame:
    """Row order of the comparison table: (disposition, list_no, units).

    Names in order of first appearance when reading the 12-, 3- and 1-month lists
    one after the other, each sorted by units.
    """
    lists = period_dispositions(orders, returns, as_of, match_blank_ids)
    order = {n: i for i, n in enumerate(sorted(schema.PERIODS.values(), reverse=True), 1)}
    list_no = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("months"))
    first = lists.groupBy("disposition").agg(
        F.min(F.struct(list_no.alias("list_no"), F.col("units"))).alias("at")
    )
    return first.select("disposition", "at.list_no", "at.units").orderBy(
        "list_no", F.desc("units"), "disposition"
    )


def period_stats(
    orders: DataFrame, returns: DataFrame, as_of: dt.date, match_blank_ids: bool = True
) -> DataFrame:
    """(period, months, orders_units, returns_total, sellable, unsellable): three rows."""
    months = ranked_months(orders, as_of)
    back = _totals(_returned(orders, returns, months, match_blank_ids))
    sold = F.broadcast(_order_units(months).drop("months"))  # three rows by construction
    stats = back.join(sold, "period").select(
        "period", "months", "orders_units", "returns_total", "sellable", "unsellable"
    )
    return stats.orderBy("months")


def _pct(num: str, den: str) -> Column:
    """Percent for the table: missing if either side is 0."""
    return F.when(F.col(num) != 0, safe_ratio_pct(num, den, 1))


def period_table(
    orders: DataFrame, returns: DataFrame, as_of: dt.date, match_blank_ids: bool = True
) -> DataFrame:
    """Metrics by period, in the order of the comparison table.

    (position, metric, disposition, label, last_month, last_3_months,
    last_12_months); percentages are NULL where there is nothing to relate.
    """
    months = ranked_months(orders, as_of)
    returned = _returned(orders, returns, months, match_blank_ids)
    # A few dozen rows: every disposition in every period, and a row per period for the
    # orders. Totals of a period stand beside each of its rows, so the attribution is
    # computed once for both.
    weight = F.col(f"units_{LONGEST}").alias("weight")
    each = _per_period(returned.select("*", weight), ["units", "seen"], ["disposition", "weight"])
    rows = each.unionByName(_order_units(months), allowMissingColumns=True)
    period = Window.partitionBy("period")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(period), F.lit(0))

    rows = rows.select(
        "*",
        F.max("orders_units").over(period).alias("sold"),
        total(F.col("units")).alias("returns_total"),
        total(F.when(F.col("disposition") == schema.SELLABLE, F.col("units"))).alias("sellable"),
        total(F.when(_is_unsellable(), F.col("units"))).alias("unsellable"),
    )
    of_all = rows.filter(F.col("orders_units").isNotNull()).select("period", F.inline(_metrics([
        (1, "orders_units", F.col("sold")),
        (2, "returns", F.col("returns_total")),
        (3, "returns_pct_of_orders", _pct("returns_total", "sold")),
        (4, "unsellable", F.col("unsellable")),
        (5, "unsellable_pct_of_orders", _pct("unsellable", "sold")),
        (6, "unsellable_pct_of_returns", _pct("unsellable", "returns_total")),
        (10, "sellable", F.col("sellable")),
        (11, "sellable_pct_of_orders", _pct("sellable", "sold")),
        (12, "sellable_pct_of_returns", _pct("sellable", "returns_total")),
    ]))).withColumns({"disposition": F.lit(""), "weight": F.lit(None).cast(EXACT)})
    of_each = rows.filter(F.col("seen") & _is_unsellable()).select(
        "period", "disposition", "weight", F.inline(_metrics([
            (7, "units", F.col("units")),
            (8, "units_pct_of_returns", _pct("units", "returns_total")),
            (9, "units_pct_of_unsellable", _pct("units", "unsellable")),
        ]))
    )
    names = list(schema.PERIODS)
    table = (
        of_all.unionByName(of_each)
        .groupBy("position", "metric", "disposition", "weight")
        .pivot("period", names)
        .agg(F.max("value"))
    )
    # A disposition absent from a period sold nothing there; its shares stay missing.
    is_units = F.col("metric") == "units"
    filled = [F.when(is_units, F.coalesce(p, F.lit(0.0))).otherwise(F.col(p)).alias(p) for p in names]
    rows = table.select("position", "metric", "disposition", "weight", *filled)
    section = F.when(F.col("disposition") != "", FIRST_SHARE).otherwise(F.col("position"))
    in_order = rows.orderBy(section, F.desc("weight"), "disposition", "position")
    return in_order.select(
        "position", "metric", "disposition", label_disposition("disposition").alias("label"), *names
    )


def _metrics(rows: list[tuple[int, str, Column]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("metric"),
                value.cast("double").alias("value"),
            )
            for position, name, value in rows
        ]
    )
