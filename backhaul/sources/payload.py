"""JSON imports: canonical records built elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import year_month, year_text
from .sheets import SEQ, arrival_order


def _read(spark: SparkSession, path: str, record: T.StructType, wrapped: bool, multiline: bool) -> DataFrame:
    if not wrapped:
        rows = spark.read.schema(record).option("multiLine", multiline).json(path)
        return rows.select("*", arrival_order().alias(SEQ))
    body = T.StructType([T.StructField("rows", T.ArrayType(record))])
    posts = spark.read.schema(body).option("multiLine", multiline).json(path)
    numbered = posts.select(arrival_order().alias("post"), F.posexplode("rows").alias("pos", "rec"))
    return numbered.select("rec.*", F.struct("post", "pos").alias(SEQ))


def orders_from_payload(records: DataFrame) -> DataFrame:
    """Add the derived columns of the orders table."""
    return records.withColumns(
        {"purchase_ym": year_month("purchase_date"), "purchase_y": year_text("purchase_date")}
    )


def returns_from_payload(records: DataFrame) -> DataFrame:
    """Name the return month as stored and add the derived columns."""
    return records.withColumnRenamed("return_date_parsed", "return_month").withColumns(
        {"return_ym": year_month("return_date"), "return_y": year_text("return_date")}
    )


def read_orders_payload(
    spark: SparkSession, path: str, wrapped: bool = False, multiline: bool = False
) -> DataFrame:
    """Canonical order records from JSON lines (or arrays with ``multiline``).

    ``wrapped`` reads request bodies of the form ``{"rows": [...]}``.
    """
    return orders_from_payload(_read(spark, path, schema.ORDERS_PAYLOAD, wrapped, multiline))


def read_returns_payload(
    spark: SparkSession, path: str, wrapped: bool = False, multiline: bool = False
) -> DataFrame:
    return returns_from_payload(_read(spark, path, schema.RETURNS_PAYLOAD, wrapped, multiline))
