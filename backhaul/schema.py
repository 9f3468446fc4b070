"""Table schemas, raw header spellings and fixed domain values."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
SEQ = "seq"  # arrival order of a row: any orderable column


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "MONEY": MONEY,
    "TIMESTAMP": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Fields from ``name TYPE`` pairs; parsing real DDL would need a live session."""
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ORDERS = _struct(
    "id STRING, identifier STRING, purchase_month STRING, purchase_date STRING, "
    "purchase_week INT, brand STRING, amazon_order_id STRING, order_status STRING, "
    "product_name STRING, sku STRING, asin STRING, item_status STRING, quantity BIGINT, "
    "item_price MONEY, item_tax MONEY, row_hash STRING, "
    # derived when a row is normalized
    "purchase_ym STRING, purchase_y STRING"
)

RETURNS = _struct(
    "id STRING, purchase_month STRING, purchase_date STRING, return_month STRING, "
    "return_year STRING, return_date STRING, return_week INT, order_id STRING, sku STRING, "
    "asin STRING, fnsku STRING, product_name STRING, quantity BIGINT, disposition STRING, "
    "reason STRING, status STRING, gender STRING, brand STRING, customer_comments STRING, "
    "row_hash STRING, "
    # derived when a row is normalized
    "return_ym STRING, return_y STRING"
)

UPLOAD_LOG = _struct(
    "id STRING, filename STRING, file_hash STRING, type STRING, rows_added BIGINT, "
    "rows_skipped BIGINT, uploaded_by STRING, uploaded_at TIMESTAMP"
)

# JSON import payloads: canonical records without the id and the derived columns.
# The return month arrives under the name ``return_date_parsed``.
ORDERS_PAYLOAD = T.StructType(
    [f for f in ORDERS if f.name not in ("id", "purchase_ym", "purchase_y")]
)
RETURNS_PAYLOAD = T.StructType(
    [
        T.StructField("return_date_parsed", f.dataType) if f.name == "return_month" else f
        for f in RETURNS
        if f.name not in ("id", "return_ym", "return_y")
    ]
)

# --- fixed values: raw header spellings, first non-empty wins -----------------
ORDER_HEADERS = {
    "identifier": ("Identifier", "Duplicate Id"),
    "purchase_month": ("Purchase Month",),
    "purchase_date": ("Purchase Date2", "purchase-date"),
    "brand": ("Brand",),
    "amazon_order_id": ("amazon-order-id",),
    "order_status": ("order-status",),
    "product_name": ("product-name",),
    "sku": ("sku",),
    "asin": ("asin",),
    "item_status": ("item-status",),
    "quantity": ("quantity",),
    "item_price": ("item-price",),
    "item_tax": ("item-tax",),
}
# The row hash reads the raw date with the opposite preference.
ORDER_HASH_DATE_HEADERS = ("purchase-date", "Purchase Date2")

RETURN_HEADERS = {
    "purchase_month": ("Purchase Month",),
    "purchase_date": ("Purchase Date",),
    "return_month": ("Return Month",),
    "return_year": ("Return Year",),
    "return_date": ("Return Date2", "Return Date", "return-date"),
    "order_id": ("Order ID", "order-id"),
    "sku": ("SKU", "sku"),
    "asin": ("ASIN", "asin"),
    "fnsku": ("FNSKU", "fnsku"),
    "product_name": ("Product Name", "product-name"),
    "quantity": ("Quantity", "quantity"),
    "disposition": ("Detailed-disposition", "detailed-disposition"),
    "reason": ("Reason", "reason"),
    "status": ("Status", "status"),
    "gender": ("Gender", "gender"),
    "brand": ("Brand", "brand"),
    "customer_comments": ("Customer-comments", "customer-comments"),
}

# Any of these (lower-cased) marks a sheet as a returns sheet.
RETURNS_MARKER_HEADERS = frozenset(
    {"return-date", "return date", "return date2", "detailed-disposition", "return month"}
)

ORDERS_SHEET = "All Orders Raw"
RETURNS_SHEET = "Return Raw"

# --- fixed values: statuses and placeholders -----------------------------------
SHIPPED = "Shipped"
CANCELLED = "Cancelled"
ON_TRIAL = "On Trial"
SELLABLE = "SELLABLE"
BRAND_PLACEHOLDER = "-"

PAGE_SIZE = 50
TOP_BRANDS = 20
TOP_REASONS = 10
CHART_MONTHS = 18
HIGH_RATE = 0.10
# Trailing periods: name -> number of months
PERIODS = {"last_month": 1, "last_3_months": 3, "last_12_months": 12}
