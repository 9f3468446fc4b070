"""Registered queries: every operator over the whole tables of a folder."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul import functions as fn
from backhaul import operators as op
from backhaul import plans, schema
from backhaul.operators.attribution import ORDER_ID, lines_per_order, total_units, units_per_order
from backhaul.session import apply_runtime, scratch_root
from backhaul.sources import Sheet, SnapshotTable, content_digest, line_sums, star, upload_history
from backhaul.sources.log import append_log, log_entries
from backhaul.sources.payload import read_returns_payload
from backhaul.sources.staging import staged, written
from backhaul.streaming import stream_ingest as stream_folder
from backhaul.streaming import stream_rows

AS_OF = star.AS_OF
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SEARCH = {"search": "GEAR"}
SEARCHES = [
    {"search": "GEAR", "reason": "DEFECTIVE", "disposition": "SELLABLE"},
    {"brand": "Brand#2"},
    {"month": "March 1999"},
    {"search": "GEAR", "brand": "Brand#2", "reason": "NOT_AS_DESCRIBED"},
    {"search": "a", "brand": "Brand#2", "month": "March 1999", "reason": "DEFECTIVE", "disposition": "SELLABLE"},
]

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(apply_runtime(spark), folder)

    _REGISTRY[query.__name__] = run
    return query


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- tables ---------------------------------------------------------------------


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines without product and brand, which no order report reads."""
    return star.order_lines(spark, folder, with_part=False)


def returns(spark: SparkSession, folder: str) -> DataFrame:
    """Returns without product and brand."""
    return star.return_records(spark, folder, with_part=False)


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _number_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Number-like text of every shape the parser must cope with, made of line items."""
    line, supplier = _text("l_linenumber"), _text("l_suppkey")
    shapes = [
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)),
        F.lit(""),
        F.concat(F.lit("--"), line),
        F.concat(line, F.lit("-2")),
        F.concat(line, F.lit(".2.3")),
        F.concat(F.lit("-."), line),
        F.concat(line, F.lit(".")),
        F.concat(F.lit("("), supplier, F.lit(")")),
        F.lit("abc"),
        F.concat(line, F.lit("e5")),
        F.lit("-"),
        F.lit("."),
        F.concat(F.lit("USD "), supplier),
        F.lit("0.5"),
        F.concat(line, F.lit(".5")),
        F.concat(F.lit("-"), line, F.lit(".25")),
    ]
    return _cells(spark, folder, shapes)


def _date_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Date-like text: time stamps, padding, other orders of day and month, blanks."""
    day = F.col("l_shipdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    shapes = [
        F.concat(iso, F.lit("T10:00:00+00:00")),
        F.concat(F.lit(" "), iso, F.lit(" ")),
        F.date_format(day, "M/d/yyyy"),
        F.lit(""),
        F.lit(None).cast("string"),
        iso,
    ]
    return _cells(spark, folder, shapes)


def _cells(spark: SparkSession, folder: str, shapes: list[Column]) -> DataFrame:
    kind = F.col("l_partkey") % len(shapes)
    cell = F.when(kind == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        cell = cell.when(kind == i, shape)
    return _lines(spark, folder).withColumn("cell", cell)


# --- sources and imports -----------------------------------------------------------


@register
def ingest_orders(spark, folder):
    return as_double(op.normalize_orders(star.raw_orders(spark, folder)), "item_price", "item_tax")


@register
def ingest_returns(spark, folder):
    return op.normalize_returns(star.raw_returns(spark, folder))


@register
def import_orders(spark, folder):
    first, second = star.order_batches(spark, folder)
    return op.ingest_actions(op.first_by_hash(first, ["id"]), second, "id")


def _stored_returns(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The returns table after the first batch, and the second batch."""
    first, second = star.return_batches(spark, folder)
    return op.upsert_disposition(first.filter(F.lit(False)), first, "id"), second


@register
def import_returns(spark, folder):
    stored, batch = _stored_returns(spark, folder)
    counts = op.upsert_counts(stored, batch, "id")
    actions = [F.struct(F.lit(a).alias("action"), F.col(a).alias("n")) for a in counts.columns]
    return counts.select(F.inline(F.array(*actions))).filter(F.col("n") > 0)


@register
def upload_history_newest(spark, folder):
    """A log derived from the orders, one load per order day; logged twice, kept once."""
    sold = spark.read.parquet(f"{folder}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    loads = sold.groupBy(day.alias("day")).agg(
        F.count("*").alias("rows_added"), F.count_if(F.col("o_orderstatus") == "O").alias("rows_skipped")
    )
    name = F.concat(F.lit("orders-"), F.col("day"))
    entries = log_entries(
        loads.select(
            F.col("day").alias("id"),
            F.concat(name, F.lit(".csv")).alias("filename"),
            F.md5(name).alias("file_hash"),
            F.lit("orders").alias("type"),
            "rows_added",
            "rows_skipped",
            F.lit("Team Member").alias("uploaded_by"),
            F.to_timestamp("day").alias("uploaded_at"),
        )
    )
    log = append_log(entries.filter(F.lit(False)), entries)
    log = log.unionByName(append_log(log, entries))
    return upload_history(log).select(
        "filename",
        "file_hash",
        "type",
        "rows_added",
        "rows_skipped",
        F.date_format("uploaded_at", "yyyy-MM-dd").alias("uploaded_on"),
    )


_REGISTRY["upload_history"] = _REGISTRY.pop("upload_history_newest")


@register
def export_monthly(spark, folder):
    return plans.export_monthly(monthly_summary(spark, folder))


@register
def export_weekly(spark, folder):
    return plans.export_weekly(weekly_summary(spark, folder), "1998")


@register
def export_returns(spark, folder):
    return op.export_returns(star.return_records(spark, folder), reason="TOO_SMALL")


# --- scalars ----------------------------------------------------------------------------


@register
def parse_num(spark, folder):
    return _number_cells(spark, folder).select(*LINE_KEY, "cell", fn.parse_num("cell").alias("number"))


@register
def parse_date_text(spark, folder):
    return _date_cells(spark, folder).select(*LINE_KEY, "cell", fn.parse_date_text("cell").alias("parsed"))


@register
def parse_date_serial(spark, folder):
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit(dt.date(1995, 1, 1)))
    serial = (days * 16 + F.col("l_partkey") % 59 + 0.75).cast("double")
    rows = _lines(spark, folder).select(*LINE_KEY, serial.alias("serial"))
    return rows.select("*", fn.parse_date_serial("serial").alias("parsed"))


@register
def week_number(spark, folder):
    return _date_cells(spark, folder).select(*LINE_KEY, "cell", fn.week_number("cell").alias("week"))


@register
def row_hash(spark, folder):
    hashed = fn.row_hash(_text("l_orderkey"), "cell", _text("l_linenumber"))
    return _date_cells(spark, folder).select(*LINE_KEY, hashed.alias("row_hash"))


@register
def js_number_text(spark, folder):
    return _lines(spark, folder).select(
        *LINE_KEY,
        fn.js_number_text("l_extendedprice").alias("price"),
        fn.js_number_text("l_quantity").alias("quantity"),
    )


@register
def first_nonblank(spark, folder):
    second = F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise("")
    picked = fn.first_nonblank("cell", second, "l_returnflag")
    return _date_cells(spark, folder).select(*LINE_KEY, picked.alias("picked"))


@register
def derive_return_month(spark, folder):
    given = F.when(F.col("l_linenumber") == 1, " Feb").otherwise(" ")
    month = fn.derive_return_month(given, fn.parse_date_text("cell"))
    return _date_cells(spark, folder).select(*LINE_KEY, month.alias("return_month"))


@register
def derive_return_year(spark, folder):
    given = F.when(F.col("l_linenumber") == 1, "1999").otherwise("")
    year = fn.derive_return_year(given, fn.parse_date_text("cell"))
    return _date_cells(spark, folder).select(*LINE_KEY, year.alias("return_year"))


@register
def default_quantity(spark, folder):
    """The defaults as functions, and what loading a sheet makes of the same cells."""
    number = fn.parse_num("cell")
    cells = _number_cells(spark, folder).select(
        *LINE_KEY,
        fn.order_quantity(number).cast("double").alias("of_order"),
        fn.return_quantity(number).cast("double").alias("of_return"),
        "cell",
    )
    carried = [*LINE_KEY, "of_order", "of_return"]
    sold = Sheet.of(cells.withColumn("quantity", F.col("cell")), [*carried, "cell"])
    sold = op.normalize_orders(sold).withColumnRenamed("quantity", "order_units")
    back = sold.select(*carried, "order_units", F.col("cell").alias("Quantity"))
    back = op.normalize_returns(Sheet.of(back, [*carried, "order_units"]))
    return back.select(*carried, "order_units", F.col("quantity").alias("return_units"))


@register
def year_month(spark, folder):
    return _date_cells(spark, folder).select(*LINE_KEY, fn.year_month("cell").alias("ym"))


@register
def year_text(spark, folder):
    return _date_cells(spark, folder).select(*LINE_KEY, fn.year_text("cell").alias("year"))


@register
def current_ym(spark, folder):
    sold = spark.read.parquet(f"{folder}/orders.parquet")
    return sold.select("o_orderkey", fn.current_ym(F.col("o_orderdate")).alias("ym"))


def _ratios(spark: SparkSession, folder: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("bigint")
    return (
        _lines(spark, folder)
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0)).alias("num"),
            F.sum(F.when(F.col("l_linestatus") == "F", quantity).otherwise(0)).alias("den"),
        )
    )


@register
def safe_ratio_pct(spark, folder):
    return _ratios(spark, folder).select(
        "o_orderkey",
        fn.safe_ratio_pct("num", "den", 2).alias("pct"),
        fn.safe_ratio_pct("num", "den", 1, 0.0).alias("pct_or_zero"),
    )


@register
def high_rate_flag(spark, folder):
    return _ratios(spark, folder).select("o_orderkey", fn.high_rate_flag("num", "den").alias("high"))


@register
def label_underscores(spark, folder):
    return returns(spark, folder).select("id", fn.label_underscores("reason").alias("label"))


@register
def label_disposition(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    text = F.concat_ws("_", "p_type", "p_name", F.lower("p_brand"))
    return part.select("p_partkey", fn.label_disposition(text).alias("label"))


@register
def label_month(spark, folder):
    months = plans.monthly_orders(orders(spark, folder))
    return months.select("month", fn.label_month("month").alias("label"))


@register
def money_label(spark, folder):
    sold = spark.read.parquet(f"{folder}/orders.parquet")
    return sold.select(
        "o_orderkey",
        fn.money_label("o_totalprice").alias("total"),
        fn.count_label("o_custkey").alias("customer"),
    )


@register
def page_count(spark, folder):
    counts = star.return_records(spark, folder).groupBy("brand").agg(F.count("*").alias("n"))
    return counts.select("brand", fn.page_count("n").alias("pages"))


# --- filters ----------------------------------------------------------------------------


@register
def nonblank_filter(spark, folder):
    return returns(spark, folder).filter(fn.non_blank("reason")).select("id", "reason")


@register
def status_filter(spark, folder):
    kept = orders(spark, folder).filter(F.col("order_status") != schema.ON_TRIAL)
    return kept.select("id", "order_status", "quantity")


@register
def month_membership(spark, folder):
    rows = orders(spark, folder)
    months = plans.period_months(rows, AS_OF).filter(F.col("months") == 12)
    return rows.join(F.broadcast(months), rows["purchase_ym"] == months["month"], "left_semi").select(
        "id", "purchase_ym"
    )


@register
def placeholder_filter(spark, folder):
    return star.return_records(spark, folder).filter(fn.not_placeholder("brand")).select("id", "brand")


@register
def unsellable_filter(spark, folder):
    kept = returns(spark, folder).filter(~F.col("disposition").isin("", schema.SELLABLE))
    return kept.select("id", "disposition")


def _in_parts(found: Callable[[dict[str, str]], DataFrame]) -> DataFrame:
    parts = [found(c).select(F.lit(i).alias("part"), "*") for i, c in enumerate(SEARCHES)]
    return reduce(DataFrame.unionByName, parts)


@register
def search_returns(spark, folder):
    """Every constraint alone or with others."""
    rows = star.return_records(spark, folder)
    return _in_parts(lambda constraints: op.search_returns(rows, **constraints))


@register
def filtered_count(spark, folder):
    rows = star.return_records(spark, folder)
    return _in_parts(lambda constraints: op.filtered_count(rows, **constraints))


@register
def all_orders(spark, folder):
    return as_double(star.order_lines(spark, folder), "item_price", "item_tax")


@register
def all_returns(spark, folder):
    return star.return_records(spark, folder)


@register
def cleanup_bad_orders(spark, folder):
    return op.drop_bad_orders(orders(spark, folder)).select(
        "id", "amazon_order_id", "purchase_date", "order_status"
    )


@register
def cleanup_empty_disposition(spark, folder):
    return op.drop_blank_dispositions(returns(spark, folder)).select("id", "disposition")


# --- joins and aggregations ---------------------------------------------------------------


@register
def returns_by_purchase_month(spark, folder):
    back, sold = returns(spark, folder), orders(spark, folder)
    units = units_per_order(
        back, {"units": F.col("quantity"), "records": F.lit(1)}, keys=["disposition"]
    )
    lines = lines_per_order(
        sold.withColumnRenamed("purchase_ym", "month"), {"lines": F.lit(1)}, keys=["month"]
    )
    sums = units.join(lines, ORDER_ID).groupBy("month", "disposition").agg(
        total_units(F.col("units"), F.col("lines")).alias("units"),
        total_units(F.col("records"), F.col("lines")).alias("matches"),
    )
    return as_double(sums, "units", "matches")


@register
def order_stats(spark, folder):
    return plans.order_stats(orders(spark, folder))


@register
def return_stats(spark, folder):
    return plans.return_stats(returns(spark, folder))


@register
def monthly_orders(spark, folder):
    return plans.monthly_orders(orders(spark, folder))


@register
def monthly_returns(spark, folder):
    return as_double(plans.monthly_returns(orders(spark, folder), returns(spark, folder)), "return_units")


@register
def weekly_returns(spark, folder):
    return plans.weekly_returns(returns(spark, folder))


@register
def weekly_orders(spark, folder):
    return plans.weekly_orders(orders(spark, folder))


@register
def returns_by_reason(spark, folder):
    return plans.returns_by_reason(returns(spark, folder))


@register
def returns_by_disposition(spark, folder):
    return plans.returns_by_disposition(returns(spark, folder))


@register
def returns_by_brand(spark, folder):
    return plans.returns_by_brand(star.return_records(spark, folder))


@register
def returns_by_gender(spark, folder):
    return plans.returns_by_gender(returns(spark, folder))


@register
def returns_diagnostic(spark, folder):
    return plans.returns_diagnostic(returns(spark, folder))


@register
def returns_by_year(spark, folder):
    return plans.returns_by_year(returns(spark, folder))


@register
def maintenance_counts(spark, folder):
    sold, back = orders(spark, folder), returns(spark, folder)
    parts = [
        op.maintenance_counts(sold, op.drop_bad_orders(sold), "cleanup_bad_orders"),
        op.maintenance_counts(back, op.drop_blank_dispositions(back), "cleanup_empty_disposition"),
        op.maintenance_counts(sold, op.dedup_orders(sold), "dedup_orders"),
        op.maintenance_counts(back, op.dedup_returns(back), "dedup_returns"),
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionAll(part)
    return counts


@register
def ingest_counts(spark, folder):
    """Counts per dataset, load and action of two order loads and two return imports."""
    o1, o2 = star.line_batches(spark, folder)
    r1, r2 = star.return_batches(spark, folder)
    no_orders, no_returns = o1.filter(F.lit(False)), r1.filter(F.lit(False))

    def load(stored, batch, n):
        counts = op.ingest_actions(stored, batch, "id")
        pair = F.array(*[F.struct(F.lit(a).alias("action"), F.col(a).alias("n")) for a in ("added", "skipped")])
        return counts.select(F.lit("orders").alias("dataset"), F.lit(n).alias("batch"), F.inline(pair))

    def imported(stored, batch, n):
        counts = op.action_counts(op.upsert_actions(stored, batch, "id"))
        return counts.select(F.lit("returns").alias("dataset"), F.lit(n).alias("batch"), "action", "n")

    parts = [
        load(no_orders, o1, 1),
        load(op.first_by_hash(o1, ["id"]), o2, 2),
        imported(no_returns, r1, 1),
        imported(op.upsert_disposition(no_returns, r1, "id"), r2, 2),
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts.filter(F.col("n") > 0)


# --- windows ----------------------------------------------------------------------------------


@register
def dedup_orders(spark, folder):
    kept = op.dedup_orders(star.order_lines(spark, folder))
    return as_double(kept, "item_price", "item_tax")


def _sent_twice(spark, folder) -> DataFrame:
    """Both return batches as one table; ids sort by batch, then record."""
    first, second = star.return_batches(spark, folder)

    def numbered(df: DataFrame, n: str) -> DataFrame:
        return df.withColumn("id", F.concat_ws("|", F.lit(n), "id"))

    return numbered(first, "1").unionByName(numbered(second, "2"))


@register
def dedup_returns(spark, folder):
    return op.dedup_returns(_sent_twice(spark, folder))


@register
def period_months(spark, folder):
    return plans.period_months(orders(spark, folder), AS_OF)


@register
def first_by_hash(spark, folder):
    return op.first_by_hash(_sent_twice(spark, folder), ["id"])


@register
def blank_state(spark, folder):
    stored, batch = _stored_returns(spark, folder)
    return op.upsert_actions(stored, batch, "id")


@register
def recent_months(spark, folder):
    return as_double(plans.recent_months(monthly_summary(spark, folder)).select("month", "order_units", "return_units"), "return_units")


# --- sorts and limits -----------------------------------------------------------------------------


@register
def returns_page(spark, folder):
    return op.returns_page(star.return_records(spark, folder), page=3)


@register
def returns_page_deep(spark, folder):
    return op.returns_page(star.return_records(spark, folder), page=31)


@register
def top_reasons(spark, folder):
    return plans.top_reasons(returns(spark, folder))


@register
def diagnostic_samples(spark, folder):
    return plans.diagnostic_samples(returns(spark, folder))


@register
def unsellable_rank(spark, folder):
    ranked = plans.period_dispositions(orders(spark, folder), returns(spark, folder), AS_OF)
    return as_double(ranked.filter(F.col("months") == 12).select("disposition", "units"), "units")


# --- sets ---------------------------------------------------------------------------------------------


@register
def facet_values(spark, folder):
    return op.facet_values(star.return_records(spark, folder))


@register
def facet_months(spark, folder):
    return op.facet_months(returns(spark, folder))


@register
def distinct_years(spark, folder):
    return plans.distinct_years(plans.weekly_orders(orders(spark, folder)))


@register
def period_disposition_names(spark, folder):
    return as_double(plans.period_disposition_names(orders(spark, folder), returns(spark, folder), AS_OF), "units")


# --- modification --------------------------------------------------------------------------------------


@register
def insert_ignore(spark, folder):
    first, second = star.line_batches(spark, folder)
    new = op.insert_ignore(second, op.first_by_hash(first, ["id"]), ["id"])
    return as_double(star.batch_rows(new), "item_price", "item_tax")


@register
def insert_ignore_batch(spark, folder):
    first, second = star.line_batches(spark, folder)
    with staged(op.repeated_hashes(first)) as again:
        left_out = written(op.repeated_rows(first, again, star.LINE, ["id"]))
    stored = op.first_by_hash(first, ["id"], left_out=(star.LINE, left_out))
    table = stored.unionByName(op.insert_ignore(second, stored, ["id"], small=False))
    return as_double(star.batch_rows(table), "item_price", "item_tax")


@register
def upsert_disposition(spark, folder):
    stored, batch = _stored_returns(spark, folder)
    table = op.upsert_disposition(stored, batch, "id")
    return table.withColumn("disposition", F.coalesce("disposition", F.lit("")))


@register
def stream_ingest(spark, folder):
    """All line items as a file stream, made returns and loaded first-wins into a table."""
    root = _scratch(spark, "stream")
    table = SnapshotTable(spark, f"{root}/returns", schema.RETURNS, "return_ym", ["order_id"])
    part = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name", "p_brand")
    lines = (
        spark.readStream.schema(_lines(spark, folder).schema)
        .parquet(f"{folder}/lineitem.parquet*")  # a glob: the source takes folders or patterns
        .filter(F.col("l_returnflag") == "R")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    stream_rows(star.return_rows(lines), table, f"{root}/checkpoint", "id").awaitTermination()
    return table.read()


# --- the way of a file: sheet, table, log ----------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def export_sheet(spark: SparkSession, sheet: Sheet, path: str) -> list[str]:
    """Write a sheet, whose rows are in the order of their ids, as compressed text under its raw headers.

    Some headers differ in case only, and some cells begin or end with blanks. There is a part
    for every range of ids, so reading them is still the work of many tasks.
    """
    in_order = sheet.rows.select(*sheet.headers.values())
    case = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        writer = in_order.toDF(*sheet.headers).write.option("header", True).option("escape", '"').option("compression", "gzip")
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    finally:
        spark.conf.set("spark.sql.caseSensitive", case)
    return list(sheet.headers)


def _without_id(rows: DataFrame) -> DataFrame:
    """Ids of loaded rows say when they were loaded."""
    money = [c for c in ("item_price", "item_tax") if c in rows.columns]
    return as_double(rows.drop("id"), *money)


@register
def file_fingerprint(spark, folder):
    """The fingerprint of a sheet of all orders, a folder of parts in the order of their keys."""
    path = f"{_scratch(spark, 'sheet')}/orders.psv"
    sold = spark.read.parquet(f"{folder}/orders.parquet").orderBy("o_orderkey")
    line = F.concat_ws("|", _text("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus")
    sold.select(line).write.text(path)
    return line_sums(spark, path).select("lines", content_digest())


@register
def load_orders(spark, folder):
    """The raw orders sheet, written as delimited text and loaded by its headers."""
    root = _scratch(spark, "load")
    export_sheet(spark, star.raw_orders(spark, folder, in_order=True), f"{root}/orders.csv")
    tables = plans.open_tables(spark, f"{root}/tables")
    plans.load_sheet_file(spark, tables, f"{root}/orders.csv")
    return _without_id(tables.orders.read())


@register
def load_returns(spark, folder):
    """The raw returns sheet, loaded twice; the second time adds nothing."""
    root = _scratch(spark, "load")
    export_sheet(spark, star.raw_returns(spark, folder, in_order=True), f"{root}/returns.csv")
    tables = plans.open_tables(spark, f"{root}/tables")
    for _ in range(2):
        plans.load_sheet_file(spark, tables, f"{root}/returns.csv")
    return _without_id(tables.returns.read())


def _load_book(spark: SparkSession, folder: str) -> tuple[plans.Tables, str]:
    """Both raw sheets as a workbook of the two sheets that always load."""
    root = _scratch(spark, "load")
    export_sheet(spark, star.raw_orders(spark, folder, in_order=True), f"{root}/orders.csv")
    export_sheet(spark, star.raw_returns(spark, folder, in_order=True), f"{root}/returns.csv")
    tables = plans.open_tables(spark, f"{root}/tables")
    sheets = {schema.ORDERS_SHEET: f"{root}/orders.csv", schema.RETURNS_SHEET: f"{root}/returns.csv"}
    plans.load_workbook(spark, tables, sheets, filename="book")
    return tables, root


@register
def load_log(spark, folder):
    """The log of a workbook, and of its returns sheet sent again twice."""
    tables, root = _load_book(spark, folder)
    for _ in range(2):
        plans.load_sheet_file(spark, tables, f"{root}/returns.csv")
    return upload_history(tables.log.read()).select("filename", "type", "rows_added", "rows_skipped")


@register
def load_payload(spark, folder):
    """Two returns imports from JSON records, which come without ids."""
    loaded = _without_id(_imported(spark, folder).returns.read())
    return loaded.withColumn("disposition", F.coalesce("disposition", F.lit("")))


def _imported(spark: SparkSession, folder: str) -> plans.Tables:
    """Both return batches, imported one after the other; the second one rewrites months."""
    root = _scratch(spark, "load")
    tables = plans.open_tables(spark, f"{root}/tables")
    for n, batch in enumerate(star.return_batches(spark, folder, in_order=True)):
        records = batch.withColumnRenamed("return_month", "return_date_parsed")
        records.select(*schema.RETURNS_PAYLOAD.names).write.option("compression", "gzip").json(f"{root}/batch-{n}")
        plans.load_payload(tables, read_returns_payload(spark, f"{root}/batch-{n}"), "returns")
    return tables


@register
def rollup_page(spark, folder):
    """Two pages of imported returns, found by the counts of dates kept with the loads."""
    tables = _imported(spark, folder)
    pages = [plans.rollups.page(tables, n).withColumn("page", F.lit(n)) for n in (3, 40)]
    return pages[0].unionAll(pages[1]).drop("id").withColumn("disposition", F.coalesce("disposition", F.lit("")))


@register
def rollup_values(spark, folder):
    """Breakdowns and filter values of imported returns without blank dispositions, from sums kept with the loads."""
    tables = _imported(spark, folder)
    plans.maintain(tables, "cleanup_empty_disposition")
    parts = plans.rollups.breakdowns(tables).withColumn("earliest", F.lit(None).cast("string"))
    options = plans.rollups.filter_options(tables).withColumns(
        {"records": F.lit(None).cast("bigint"), "units": F.lit(None).cast("bigint")}
    )
    options = options.withColumn("dimension", F.concat(F.lit("filter "), "facet"))
    return parts.unionByName(options.select(*parts.columns))


def _cleaned_book(spark: SparkSession, folder: str) -> plans.Tables:
    tables, _ = _load_book(spark, folder)
    for operation in ("cleanup_bad_orders", "cleanup_empty_disposition"):
        plans.maintain(tables, operation)
    tables.returns.compact()
    return tables


@register
def rollup_weeks(spark, folder):
    """Weeks of a loaded and cleaned workbook, from sums kept with the loads."""
    return plans.rollups.weekly_summary(_cleaned_book(spark, folder))


@register
def rollup_cards(spark, folder):
    """Dashboard totals of a loaded and cleaned workbook, from sums kept with the loads."""
    return plans.rollups.dashboard_cards(_cleaned_book(spark, folder))


@register
def stream_sheets(spark, folder):
    """The raw returns sheet as files arriving in a folder."""
    root = _scratch(spark, "load")
    headers = export_sheet(spark, star.raw_returns(spark, folder, in_order=True), f"{root}/returns.csv")
    tables = plans.open_tables(spark, f"{root}/tables")
    stream_folder(spark, f"{root}/returns.csv", headers, tables, f"{root}/checkpoint").awaitTermination()
    return _without_id(tables.returns.read())


@register
def maintain_tables(spark, folder):
    """What maintenance removes from loaded tables, one operation after the other."""
    tables, _ = _load_book(spark, folder)
    done = []
    for operation in ("cleanup_bad_orders", "dedup_orders", "cleanup_empty_disposition", "dedup_returns"):
        counts = plans.maintain(tables, operation)
        done.append((operation, counts["deleted"], counts["remaining"]))
    for kind, deleted in tables.truncate().items():
        if kind != "log":
            done.append((f"truncate_{kind}", deleted, tables.of(kind).read().count()))
    return spark.createDataFrame(done, "operation string, deleted bigint, remaining bigint")


# --- reports --------------------------------------------------------------------------------------------


@register
def dashboard_cards(spark, folder):
    return plans.dashboard_cards(orders(spark, folder), returns(spark, folder))


@register
def period_order_units(spark, folder):
    return plans.period_order_units(orders(spark, folder), AS_OF)


@register
def period_returns(spark, folder):
    return as_double(plans.period_returns(orders(spark, folder), returns(spark, folder), AS_OF), "returns_total", "sellable", "unsellable")


@register
def period_dispositions(spark, folder):
    return as_double(plans.period_dispositions(orders(spark, folder), returns(spark, folder), AS_OF), "units")


@register
def period_stats(spark, folder):
    return as_double(plans.period_stats(orders(spark, folder), returns(spark, folder), AS_OF), "returns_total", "sellable", "unsellable")


@register
def period_table(spark, folder):
    return plans.period_table(orders(spark, folder), returns(spark, folder), AS_OF)


@register
def monthly_summary(spark, folder):
    return as_double(plans.monthly_summary(orders(spark, folder), returns(spark, folder)), "return_units")


@register
def weekly_summary(spark, folder):
    return plans.weekly_summary(orders(spark, folder), returns(spark, folder))


@register
def weekly_for_year(spark, folder):
    return plans.weekly_for_year(weekly_summary(spark, folder), "1997")


@register
def breakdowns(spark, folder):
    return plans.breakdowns(star.return_records(spark, folder))


@register
def returns_browser(spark, folder):
    """One page of a search together with the totals the pager shows."""
    rows = star.return_records(spark, folder)
    totals = op.page_totals(rows, page=2, **SEARCH).first()
    page = op.returns_page(rows, page=2, **SEARCH)
    return page.withColumns({c: F.lit(totals[c]).cast("bigint") for c in ("total", "pages")})


@register
def filter_options(spark, folder):
    return op.filter_options(star.return_records(spark, folder), orders(spark, folder))


@register
def returns_audit(spark, folder):
    """All parts of the audit: totals, first and last date, years, samples."""
    audit = plans.returns_audit(returns(spark, folder))
    columns = ("part", "item", "records", "detail")

    def part(name: str, df: DataFrame, item: str, records: Column, detail: Column) -> DataFrame:
        rows = df.select(F.lit(name), F.col(item), records.cast("bigint"), detail.cast("string"))
        return rows.toDF(*columns)

    def unfolded(df: DataFrame, *names: str) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in names]
        return df.select(F.inline(F.array(*pairs)))

    nothing = F.lit(None)
    totals = unfolded(audit["diagnostic"], "total", "with_order_id", "no_order_id")
    dates = unfolded(audit["diagnostic"], "earliest", "latest")
    sample = ("order_id", "asin", "return_date", "reason", "disposition")
    shown = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in sample])
    return reduce(
        DataFrame.unionAll,
        [
            part("totals", totals, "item", F.col("value"), nothing),
            part("dates", dates, "item", nothing, F.col("value")),
            part("years", audit["by_year"], "year", F.col("records"), nothing),
            part("samples", audit["samples"], "sample", nothing, shown),
        ],
    )


@register
def rate_series(spark, folder):
    return as_double(plans.rate_series(monthly_summary(spark, folder)), "return_units")
