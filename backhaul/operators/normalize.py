"""Raw sheets to canonical rows: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import (
    derive_return_month,
    derive_return_year,
    iso_date,
    order_quantity,
    parse_date,
    parse_num,
    return_quantity,
    row_hash,
    trimmed,
    week_of,
    whole_units,
    year_month,
)
from ..sources.sheets import Sheet

ORDER_TEXTS = (
    "identifier",
    "purchase_month",
    "brand",
    "amazon_order_id",
    "order_status",
    "product_name",
    "sku",
    "asin",
    "item_status",
)
RETURN_TEXTS = (
    "purchase_month",
    "order_id",
    "sku",
    "asin",
    "fnsku",
    "product_name",
    "disposition",
    "reason",
    "status",
    "gender",
    "brand",
    "customer_comments",
)


# Each step below is its own projection: a cell that later expressions read several
# times is then computed once, where nesting would compute it for every mention.


def normalize_orders(sheet: Sheet) -> DataFrame:
    """Order lines of a raw sheet, with whatever id / arrival order it carries.

    The row hash covers identifier, asin, raw date and raw price as the sheet shows
    them: untrimmed and unparsed, a zero date or price counting as empty.
    """
    heads = schema.ORDER_HEADERS
    picked = sheet.rows.select(
        *sheet.carried,
        *[sheet.raw(heads[c]).alias(c) for c in ORDER_TEXTS],
        sheet.raw(heads["purchase_date"], zero_is_missing=True).alias("purchase_date"),
        sheet.raw(schema.ORDER_HASH_DATE_HEADERS, zero_is_missing=True).alias("hash_date"),
        *[sheet.raw(heads[c]).alias(c) for c in ("quantity", "item_price", "item_tax")],
        sheet.raw(heads["item_price"], zero_is_missing=True).alias("hash_price"),
    )
    parsed = picked.select(
        *sheet.carried,
        *[trimmed(c).alias(c) for c in ORDER_TEXTS],
        parse_date("purchase_date").alias("purchase_date"),
        whole_units(order_quantity(parse_num("quantity"))).alias("quantity"),
        parse_num("item_price").try_cast(schema.MONEY).alias("item_price"),
        parse_num("item_tax").try_cast(schema.MONEY).alias("item_tax"),
        row_hash("identifier", "asin", "hash_date", "hash_price").alias("row_hash"),
    )
    dated = with_calendar(parsed, "purchase_date", "purchase")
    return _ordered(dated, sheet, schema.ORDERS.names)


def normalize_returns(sheet: Sheet) -> DataFrame:
    """Return records of a raw sheet (workbook or marketplace headers)."""
    heads = schema.RETURN_HEADERS
    texts = (*RETURN_TEXTS, "return_month", "return_year")
    dates = ("purchase_date", "return_date")
    picked = sheet.rows.select(
        *sheet.carried,
        *[sheet.raw(heads[c]).alias(c) for c in texts],
        *[sheet.raw(heads[c], zero_is_missing=True).alias(c) for c in (*dates, "quantity")],
    )
    parsed = picked.select(
        *sheet.carried,
        *[trimmed(c).alias(c) for c in texts],
        *[parse_date(c).alias(c) for c in dates],
        parse_num("quantity").alias("quantity"),
    )
    date = F.col("return_date")
    dated = parsed.withColumns(
        {
            "quantity": whole_units(return_quantity("quantity")),
            "return_month": derive_return_month("return_month", date),
            "return_year": derive_return_year("return_year", date),
            "row_hash": row_hash("order_id", "asin", date, "reason"),
        }
    )
    dated = with_calendar(dated, "return_date", "return")
    return _ordered(dated, sheet, schema.RETURNS.names)


def with_calendar(df: DataFrame, date: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_week``, ``<prefix>_ym`` and ``<prefix>_y`` of a date text."""
    # A text that is a day has its month; only the others are searched for one
    ym = F.when(F.col("_iso_day").isNotNull(), F.left(date, F.lit(7))).otherwise(year_month(date))
    read = df.withColumn("_iso_day", iso_date(date)).withColumns({f"{prefix}_ym": ym, f"{prefix}_week": week_of("_iso_day")})
    return read.withColumn(f"{prefix}_y", F.left(f"{prefix}_ym", F.lit(4))).drop("_iso_day")


def normalize(sheet: Sheet, kind: str) -> DataFrame:
    return normalize_returns(sheet) if kind == "returns" else normalize_orders(sheet)


def _ordered(df: DataFrame, sheet: Sheet, names: list[str]) -> DataFrame:
    canonical = [n for n in names if n in df.columns]
    return df.select(*canonical, *[c for c in sheet.carried if c not in canonical])
