"""Searching, paging and faceting return records."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import non_blank, not_placeholder, page_count
from ..sources.staging import forget, written

SEARCHED = ("product_name", "sku", "asin", "order_id")
WIDE = 20_000  # whole records that a page is ranked from, at most
SHORT = 1_000_000  # (date, id) pairs that a page is ranked from, at most


def contains_text(column: str, text: str) -> Column:
    """``LIKE '%text%'`` with case folding for ASCII letters only.

    ``%`` and ``_`` typed by the user stay wildcards and nothing escapes them; a
    Java pattern folds ASCII only, where ``ilike`` would fold every letter.
    """
    wild = {"%": ".*", "_": "."}
    pattern = "".join(wild.get(ch) or re.escape(ch) for ch in text)
    return F.col(column).rlike(f"(?is){pattern}")


def search_predicate(
    search: str = "", reason: str = "", brand: str = "", month: str = "", disposition: str = ""
) -> Column | None:
    """All given constraints together; an empty argument is no constraint."""
    parts = [
        F.col(name) == value
        for name, value in (
            ("reason", reason),
            ("brand", brand),
            ("return_month", month),
            ("disposition", disposition),
        )
        if value
    ]
    if search:
        parts.append(reduce(or_, [contains_text(c, search) for c in SEARCHED]))
    return reduce(and_, parts) if parts else None


def search_returns(returns: DataFrame, **constraints: str) -> DataFrame:
    predicate = search_predicate(**constraints)
    return returns if predicate is None else returns.filter(predicate)


def filtered_count(returns: DataFrame, **constraints: str) -> DataFrame:
    """One row (total) of the records a search finds."""
    return search_returns(returns, **constraints).agg(F.count("*").alias("total"))


def page_totals(returns: DataFrame, page: int = 1, **constraints: str) -> DataFrame:
    """One row (total, page, pages)."""
    total = filtered_count(returns, **constraints)
    return total.select(
        "total", F.lit(page).cast("bigint").alias("page"), page_count("total").alias("pages")
    )


def returns_page(
    returns: DataFrame,
    page: int = 1,
    page_size: int = schema.PAGE_SIZE,
    dates: DataFrame | None = None,
    **constraints: str,
) -> DataFrame:
    """One page of the records found, newest return date first, ties by id.

    Records are counted by date, which combines before the shuffle and leaves a row a day, or
    ``dates`` has those counts already (return_date, n, any number of rows a date, and return_ym
    for tables by month). Added up from the newest date on they tell which dates hold the page
    and how far in it begins: those are read, nothing else and nothing is written. Where they
    hold more than WIDE records before the page's end, their (date, id) pairs are ranked first.
    """
    rows = search_returns(returns, **constraints)
    offset = (max(page, 1) - 1) * page_size
    counts = rows.groupBy("return_date").agg(F.count("*").alias("n")) if dates is None else dates
    months = [] if dates is None or "return_ym" not in dates.columns else [F.collect_set(F.struct("return_ym")).alias("months")]
    counts = counts.filter(F.col("n") > 0).groupBy("return_date").agg(F.sum("n").alias("n"), *months)
    # One row a date: the only order there is among dates is over all of them
    newest = Window.orderBy(F.desc_nulls_last("return_date")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("begin", F.coalesce(F.sum("n").over(newest), F.lit(0)))
    held = counts.filter((F.col("begin") < offset + page_size) & (F.col("begin") + F.col("n") > offset)).collect()
    order = [F.desc_nulls_last("return_date"), F.asc_nulls_first("id")]
    if not held:
        return rows.limit(0)
    inside = rows.filter(_any_of("return_date", [r["return_date"] for r in held]))
    if months:
        inside = inside.filter(_any_of("return_ym", list({m["return_ym"] for r in held for m in r["months"]})))
    offset -= min(r["begin"] for r in held)
    if offset + page_size <= WIDE:
        return inside.orderBy(*order).offset(offset).limit(page_size)
    return _deep(inside, order, offset, page_size, sum(r["n"] for r in held))


def _deep(rows: DataFrame, order: list[Column], offset: int, page_size: int, total: int) -> DataFrame:
    """A page far into the ``total`` records of a few dates, by their (date, id) pairs. More than SHORT
    are dealt into ranges, and the ranges that hold the page again, until they are short enough to rank."""
    keys = rows.select("return_date", "id")
    copies = []
    while total > SHORT:
        dealt = written(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
        copies.append(dealt)
        counts = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}
        begin, wanted = 0, {}
        for number in sorted(counts):
            if begin < offset + page_size and begin + counts[number] > offset:
                wanted.setdefault(number, begin)
            begin += counts[number]
        total = sum(counts[number] for number in wanted)
        keys = dealt.filter(F.col("range").isin(list(wanted))).select("return_date", "id")
        offset -= min(wanted.values(), default=0)
        if total == begin:  # Spark leaves a range whole if it is a small one
            break
    found = [(r["return_date"], r["id"]) for r in keys.orderBy(*order).offset(offset).limit(page_size).collect()]
    for copy in copies:
        forget(copy)
    if not found:
        return rows.limit(0)
    kinds = [rows.schema[c].dataType for c in ("return_date", "id")]
    pair = F.struct(F.col("return_date").alias("date"), F.col("id").alias("id"))
    pairs = [F.struct(F.lit(d).cast(kinds[0]).alias("date"), F.lit(i).cast(kinds[1]).alias("id")) for d, i in found]
    picked = rows.filter(_any_of("id", [i for _, i in found]) & F.exists(F.array(*pairs), lambda p: p.eqNullSafe(pair)))
    return picked.orderBy(*order).limit(page_size)


def _any_of(column: str, values: list) -> Column:
    """Filter that scans can take: the column has one of the values."""
    some = F.col(column).isin([v for v in values if v is not None])
    return some | F.col(column).isNull() if None in values else some


def export_returns(returns: DataFrame, **constraints: str) -> DataFrame:
    """Every record a search finds, in the eleven columns of the CSV export."""
    found = search_returns(returns, **constraints)
    return found.orderBy(F.desc_nulls_last("return_date"), "id").select(
        F.col("return_date").alias("Return Date"),
        F.col("purchase_month").alias("Purchase Month"),
        F.coalesce("product_name", F.lit("")).alias("Product"),
        F.col("brand").alias("Brand"),
        F.col("reason").alias("Reason"),
        F.col("disposition").alias("Disposition"),
        F.col("gender").alias("Gender"),
        F.col("quantity").alias("Qty"),
        F.coalesce("customer_comments", F.lit("")).alias("Customer Comment"),
        F.col("order_id").alias("Order ID"),
        F.col("asin").alias("ASIN"),
    )


def facet_values(returns: DataFrame) -> DataFrame:
    """(facet, value): the distinct reasons, brands and dispositions, A to Z."""
    pairs = _facet_pairs(returns, ("reason", "brand", "disposition"))
    return pairs.select("facet", "value").distinct().orderBy("facet", "value")


def facet_months(df: DataFrame, month: str = "return_month", date: str = "return_date") -> DataFrame:
    """(value, earliest): distinct months, the one with the latest first date on top.

    Months and dates are reduced to their distinct pairs first. Those are few, and
    a text minimum, which Spark can only sort for, then runs over next to nothing.
    """
    pairs = df.filter(non_blank(month)).select(F.col(month).alias("value"), F.col(date).alias("at"))
    months = pairs.distinct().groupBy("value").agg(F.min("at").alias("earliest"))
    return months.orderBy(F.desc_nulls_last("earliest"), "value")


def filter_options(returns: DataFrame, orders: DataFrame) -> DataFrame:
    """(facet, value, earliest) for all five filters; months carry their earliest date."""
    plain = facet_values(returns).withColumn("earliest", F.lit(None).cast("string"))
    months = facet_months(returns).withColumn("facet", F.lit("return_month"))
    bought = facet_months(orders, "purchase_month", "purchase_date").withColumn(
        "facet", F.lit("purchase_month")
    )
    columns = ["facet", "value", "earliest"]
    everything = plain.select(columns).unionAll(months.select(columns)).unionAll(bought.select(columns))
    return everything.orderBy("facet", F.desc_nulls_last("earliest"), "value")


def _facet_pairs(returns: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """One scan for all facets: each row turns into one (facet, value) per facet."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])
    exploded = returns.select(F.inline(pairs))
    wanted = F.when(F.col("facet") == "brand", not_placeholder("value")).otherwise(non_blank("value"))
    return exploded.filter(wanted)
