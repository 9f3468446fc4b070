"""Order lines and returns derived from a star schema (lineitem, orders, part).

Every table the reports need, including the dirt they must cope with: blank and
shared ids, blank and non-ISO dates, missing and zero prices, placeholder brands.
All rules are arithmetic on keys, so the same rows come out at any scale.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import js_number_text, row_hash
from ..functions.hashing import packed_hash
from ..operators.normalize import with_calendar
from .sheets import Sheet
from .staging import written

AS_OF = dt.date(2001, 8, 1)  # the order dates end here


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _row_id() -> Column:
    """Of all that tells lines apart: order, line, part and supplier alone repeat in a few."""
    keys = [_text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("|", *keys, F.col("l_quantity").cast("bigint").cast("string"), _money("l_extendedprice").cast("string"))


def _mod(column: str, n: int) -> Column:
    return F.col(column) % n


def _order_id() -> Column:
    return F.when(_mod("l_suppkey", 97) == 0, "").otherwise(_text("l_orderkey"))


def _sku() -> Column:
    return F.concat(F.lit("SKU-"), _text("l_linenumber"))


def _brand() -> Column:
    tens = _mod("l_partkey", 10)
    return F.when(tens == 0, "").when(tens == 1, "-").otherwise(F.coalesce("p_brand", F.lit("")))


def _money(column: str) -> Column:
    return F.col(column).cast(schema.MONEY)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _with_part(lines: DataFrame, spark: SparkSession, folder: str, wanted: bool) -> DataFrame:
    """Part attributes, or NULLs in their place when no report column needs them."""
    if not wanted:
        nothing = F.lit(None).cast("string")
        return lines.withColumns({"p_name": nothing, "p_brand": nothing})
    part = _table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")


# What raw sheets show beyond the canonical columns: order day, line and part number.
EXTRAS = ("_order_day", "_line", "_part")
LINE = "_number"


def order_lines(spark: SparkSession, folder: str, with_part: bool = True) -> DataFrame:
    """The canonical orders table. ``with_part=False`` leaves out product and brand."""
    return _order_rows(spark, folder, with_part).drop(*EXTRAS)


def _in_order(lines: DataFrame, wanted: bool) -> DataFrame:
    """Line items by their rows' ids. Sorted before the wide rows are made of them, which are
    twice to three times as many bytes to shuffle."""
    return lines.orderBy(_row_id()) if wanted else lines


def _order_rows(spark: SparkSession, folder: str, with_part: bool, in_order: bool = False) -> DataFrame:
    return _made_orders(_in_order(_sold_lines(spark, folder, with_part), in_order))


def _sold_lines(spark: SparkSession, folder: str, with_part: bool) -> DataFrame:
    sold = _table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    lines = _table(spark, folder, "lineitem").join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
    return _with_part(lines, spark, folder, with_part)


def _identifier() -> Column:
    return F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"))


def _made_orders(lines: DataFrame) -> DataFrame:
    """Order rows made of line items with their orders and parts."""
    undated = _mod("l_partkey", 89) == 0
    day = F.col("o_orderdate")
    date = (
        F.when(undated, "")
        .when(_mod("l_partkey", 83) == 0, F.date_format(day, "M/d/yyyy"))
        .otherwise(day.cast("date").cast("string"))
    )
    price = (
        F.when(F.col("l_discount") == 0.0, F.lit(None).cast(schema.MONEY))
        .when(F.col("l_discount") == 0.01, F.lit(0).cast(schema.MONEY))
        .otherwise(_money("l_extendedprice"))
    )
    status = F.col("o_orderstatus")
    rows = lines.select(
        _row_id().alias("id"),
        _identifier().alias("identifier"),
        F.when(undated, "").otherwise(F.date_format(day, "MMMM yyyy")).alias("purchase_month"),
        date.alias("purchase_date"),
        _brand().alias("brand"),
        _order_id().alias("amazon_order_id"),
        F.when((_mod("l_suppkey", 97) == 0) & undated, "")
        .when(status == "F", schema.SHIPPED)
        .when(status == "O", schema.CANCELLED)
        .otherwise(F.when(F.col("l_linestatus") == "O", schema.ON_TRIAL).otherwise(schema.SHIPPED))
        .alias("order_status"),
        F.coalesce("p_name", F.lit("")).alias("product_name"),
        _sku().alias("sku"),
        F.concat(F.lit("ASIN-"), _text("l_partkey")).alias("asin"),
        F.when(F.col("l_linestatus") == "F", "Shipped").otherwise("Unshipped").alias("item_status"),
        F.when(status == "O", F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint").alias("quantity"),
        price.alias("item_price"),
        (_money("l_tax") * _money("l_extendedprice")).cast(schema.MONEY).alias("item_tax"),
        day.cast("date").alias("_order_day"),
        F.col("l_linenumber").alias("_line"),
        F.col("l_partkey").alias("_part"),
    )
    price_text = F.when(F.col("item_price") != 0, js_number_text("item_price"))
    hashed = rows.withColumn("row_hash", row_hash("identifier", "asin", "purchase_date", price_text))
    derived = with_calendar(hashed, "purchase_date", "purchase")
    return derived.select(*schema.ORDERS.names, *EXTRAS)


def _disposition() -> Column:
    third = _mod("l_suppkey", 3)
    damaged = F.when(third == 0, "CUSTOMER_DAMAGED").when(third == 1, "DEFECTIVE").otherwise("CARRIER_DAMAGED")
    return (
        F.when(F.col("l_tax") == 0.0, "")
        .when(F.col("l_tax") == 0.01, F.lit(None).cast("string"))
        .otherwise(F.when(F.col("l_linestatus") == "F", schema.SELLABLE).otherwise(damaged))
    )


def _reason() -> Column:
    third = _mod("l_linenumber", 3)
    return (
        F.when(F.col("l_linenumber") == 7, "")
        .when(third == 0, "TOO_SMALL")
        .when(third == 1, "NOT_AS_DESCRIBED")
        .otherwise("DEFECTIVE")
    )


def _gender() -> Column:
    fourth = _mod("l_suppkey", 4)
    return F.when(fourth == 0, "Men").when(fourth == 1, "Women").when(fourth == 2, "Unisex").otherwise("")


def _comment() -> Column:
    gap = F.when(_mod("l_suppkey", 2) == 0, "\n").otherwise(" ")
    text = F.concat(F.lit('said "'), F.lower(_reason()), F.lit('",'), gap, F.lit("sent back"))
    return F.when(_mod("l_linenumber", 4) == 0, text).otherwise("")


def return_rows(lines: DataFrame, disposition: Column | None = None) -> DataFrame:
    """Return records made of line items (which carry p_name and p_brand)."""
    undated = _mod("l_partkey", 89) == 0
    day = F.col("l_shipdate")

    def dated(text: Column) -> Column:
        return F.when(undated, "").otherwise(text)

    rows = lines.select(
        _row_id().alias("id"),
        F.lit("").alias("purchase_month"),
        F.lit(None).cast("string").alias("purchase_date"),
        dated(F.date_format(day, "MMMM yyyy")).alias("return_month"),
        dated(F.year(day).cast("string")).alias("return_year"),
        dated(day.cast("date").cast("string")).alias("return_date"),
        _order_id().alias("order_id"),
        _sku().alias("sku"),
        F.concat(F.lit("ASIN-"), _text("l_linenumber")).alias("asin"),
        F.concat(F.lit("FN-"), _text("l_partkey")).alias("fnsku"),
        F.coalesce("p_name", F.lit("")).alias("product_name"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (_disposition() if disposition is None else disposition).alias("disposition"),
        _reason().alias("reason"),
        F.lit("Unit returned").alias("status"),
        _gender().alias("gender"),
        _brand().alias("brand"),
        _comment().alias("customer_comments"),
    )
    hashed = rows.withColumn("row_hash", row_hash("order_id", "asin", "return_date", "reason"))
    derived = with_calendar(hashed, "return_date", "return")
    return derived.select(*schema.RETURNS.names)


def _flagged(spark: SparkSession, folder: str, wanted: Column, with_part: bool, in_order: bool) -> DataFrame:
    lines = _table(spark, folder, "lineitem").filter(wanted)
    return _in_order(_with_part(lines, spark, folder, with_part), in_order)


def return_records(spark: SparkSession, folder: str, with_part: bool = True, in_order: bool = False) -> DataFrame:
    """The canonical returns table."""
    return return_rows(_flagged(spark, folder, F.col("l_returnflag") == "R", with_part, in_order))


# --- replay batches --------------------------------------------------------------


def order_batches(spark: SparkSession, folder: str, with_part: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two order loads, the second sending everything again; hash of (identifier, id)."""
    rows = order_lines(spark, folder, with_part).withColumn("row_hash", row_hash("identifier", "id"))
    return rows.filter(F.col("id") < "5"), rows


def line_batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``order_batches`` as line items with id and hash, the hash as bytes: half the bytes of rows
    to decide on and a number (``LINE``). ``batch_rows`` makes the rows.

    Both batches, and all that is asked about them, read what their joins give from one written copy.
    """
    lines = _sold_lines(spark, folder, with_part=True).drop("o_orderkey", "p_partkey", "l_returnflag", "l_shipdate")
    # Quantity and price as what all read of them, and a number for each line
    lines = lines.withColumns({"l_quantity": F.col("l_quantity").cast("bigint"), "l_extendedprice": _money("l_extendedprice")})
    lines = written(lines.withColumn(LINE, F.monotonically_increasing_id())).withColumn("id", _row_id())
    lines = lines.withColumn("row_hash", packed_hash(row_hash(_identifier(), "id")))
    return lines.filter(F.col("id") < "5"), lines


def batch_rows(lines: DataFrame) -> DataFrame:
    """The rows of ``order_batches`` made of those of ``line_batches``."""
    return _made_orders(lines).drop(*EXTRAS).withColumn("row_hash", row_hash("identifier", "id"))


def return_batches(
    spark: SparkSession, folder: str, with_part: bool = True, in_order: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Two return loads, the second re-sending every fifth record with another disposition."""
    again, new = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    first = return_records(spark, folder, with_part, in_order)
    supplier = F.element_at(F.split(_row_id(), r"\|"), 4).cast("bigint")
    resent = F.when(supplier % 10 == 0, "DEFECTIVE").otherwise("")
    fifth = _flagged(spark, folder, (again | new) & (_mod("l_suppkey", 5) == 0), with_part, in_order)
    return first, return_rows(fifth, F.when(again, resent).otherwise(_disposition()))


# --- raw sheets ---------------------------------------------------------------------


def raw_orders(spark: SparkSession, folder: str, in_order: bool = False) -> Sheet:
    """The orders as an export shows them: aliases, padding, money text, day serials."""
    rows = _order_rows(spark, folder, with_part=True, in_order=in_order)
    line, part, day = F.col("_line"), F.col("_part"), F.col("_order_day")
    serial = F.datediff(day, F.lit(dt.date(1899, 12, 30)))
    stamp = F.concat(day.cast("string"), F.lit("T10:00:00+00:00"))
    price = F.coalesce(F.col("item_price").cast("string"), F.lit(""))
    dollars = F.concat(F.lit("$"), F.format_number("item_price", 2))
    cells = {
        " Identifier ": F.when(line == 5, "").otherwise(F.col("identifier")),
        "Duplicate Id": F.when(line == 5, F.concat(F.col("identifier"), F.lit(" "))).otherwise("dup"),
        "Purchase Month": F.col("purchase_month"),
        "Purchase Date2": F.when(part % 7 == 0, F.concat(serial.cast("string"), F.lit(".75")))
        .when(part % 7 == 1, "")
        .when(part % 7 == 2, "0")
        .otherwise(F.concat(F.lit(" "), F.col("purchase_date"))),
        "purchase-date": F.when(part % 89 == 0, "").otherwise(stamp),
        "Brand": F.concat(F.lit("\t"), F.col("brand"), F.lit("  ")),
        "amazon-order-id": F.col("amazon_order_id"),
        "order-status": F.col("order_status"),
        "product-name": F.col("product_name"),
        "sku": F.col("sku"),
        "asin": F.col("asin"),
        "item-status": F.col("item_status"),
        "quantity": F.when(line == 6, F.concat(F.lit("("), F.col("quantity").cast("string"), F.lit(")")))
        .when(line == 7, "n/a")
        .otherwise(F.col("quantity").cast("string")),
        "item-price": F.when((part % 3 == 0) & (F.col("item_price") > 0), dollars).otherwise(price),
        "item-tax": F.col("item_tax").cast("string"),
    }
    return Sheet.of(rows.select("id", *[c.alias(h) for h, c in cells.items()]), keep=("id",))


def raw_returns(spark: SparkSession, folder: str, in_order: bool = False) -> Sheet:
    """The returns as an export shows them: workbook and marketplace headers mixed,
    some differing in case only."""
    rows = return_records(spark, folder, in_order=in_order)
    line = F.substr("asin", F.lit(6)).cast("int")
    odd = line % 2 == 1

    def either(workbook: str, market: str, value: Column) -> dict[str, Column]:
        return {workbook: F.when(odd, value).otherwise(""), market: F.when(odd, "").otherwise(value)}

    text = F.coalesce("disposition", F.lit(""))
    date = F.col("return_date")
    stamp = F.when(date == "", "").otherwise(F.concat(date, F.lit("T08:30:00+00:00")))
    cells = {
        "Purchase Month": F.col("purchase_month"),
        "Return Month": F.when(line == 3, F.col("return_month")).otherwise(" "),
        "Return Year": F.when(line == 3, F.col("return_year")).otherwise(""),
        **either("Return Date2", "return-date", stamp),
        **either("Order ID", "order-id", F.concat(F.col("order_id"), F.lit(" "))),
        **either("SKU", "sku", F.col("sku")),
        **either("ASIN", "asin", F.col("asin")),
        **either("FNSKU", "fnsku", F.col("fnsku")),
        **either("Product Name", "product-name", F.col("product_name")),
        **either("Quantity", "quantity", F.when(line == 7, "0").otherwise(F.col("quantity").cast("string"))),
        **either("Detailed-disposition", "detailed-disposition", text),
        **either("Reason", "reason", F.concat(F.lit(" "), F.col("reason"))),
        **either("Status", "status", F.col("status")),
        **either("Gender", "gender", F.col("gender")),
        **either("Brand", "brand", F.col("brand")),
        **either("Customer-comments", "customer-comments", F.col("customer_comments")),
    }
    return Sheet.of(rows.select("id", *[c.alias(h) for h, c in cells.items()]), keep=("id",))
