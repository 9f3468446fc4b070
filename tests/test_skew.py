"""One key holding a third of all rows must not travel through one task."""

import pytest
from pyspark.sql import functions as F

from backhaul import operators as op

ROWS = 60_000
PARTS = 8


def shuffled_records(df):
    """Rows written by all exchanges of an executed plan."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if kind in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            stack.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def lines(spark):
    """A third of the rows share one order id and sku, another third have none."""
    third = F.col("id") % 3
    order_id = F.when(third == 0, "hot").when(third == 1, "").otherwise(F.concat(F.lit("o"), F.col("id")))
    return spark.range(0, ROWS, 1, PARTS).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("id"),
        order_id.alias("amazon_order_id"),
        F.lit("s").alias("sku"),
        F.lit(1.0).alias("item_price"),
        F.lit("2024-01-05").alias("purchase_date"),
        F.lit("2024-01").alias("purchase_ym"),
        F.when(third == 0, "h").otherwise(F.md5(F.col("id").cast("string"))).alias("row_hash"),
        F.lit(2).cast("bigint").alias("quantity"),
    )


def test_dedup_sends_one_row_per_task_of_a_hot_key(lines):
    kept = op.dedup_orders(lines)
    assert shuffled_records(kept) == ROWS // 3 + PARTS  # ordinary keys, and the hot one once per task
    assert kept.count() == ROWS // 3 + 1 + ROWS // 3  # ordinary, hot, blank


def test_insert_ignore_sends_one_row_per_task_of_a_hot_hash(lines):
    stored = lines.filter("row_hash = 'h'").limit(1)
    fresh = op.insert_ignore(lines, stored, ["id"])
    distinct = 2 * (ROWS // 3) + PARTS
    # the ranked rows, the batch's distinct hashes, and a handful of stored matches
    assert shuffled_records(fresh) <= 2 * distinct + 10
    assert fresh.count() == 2 * (ROWS // 3)


def test_attribution_of_hot_ids_does_not_multiply_rows(lines):
    returns = lines.select(F.col("amazon_order_id").alias("order_id"), "quantity")
    result = op.attribute_returns(returns, lines, ["purchase_ym"], {"units": F.col("quantity")})
    hot = ROWS // 3
    assert result.first()["units"] == 2 * (hot * hot + hot * hot + hot)
    # Two hot ids once per task and side; the plain join would make 2 * hot * hot rows.
    ids = hot + 2 * PARTS
    assert shuffled_records(result) <= 3 * ids + 100


def test_upsert_of_a_hot_hash(spark, lines):
    batch = lines.select("row_hash", F.col("id").alias("seq"), F.lit("").alias("disposition"))
    stored = batch.limit(0).select("row_hash", "disposition")
    hot = ROWS // 3
    counts = dict(op.action_counts(op.upsert_actions(stored, batch)).collect())
    assert counts == {"added": 2 * hot + 1, "updated": hot - 1}
    assert op.upsert_counts(stored, batch).first().asDict() == {
        "added": 2 * hot + 1,
        "updated": hot - 1,
        "skipped": 0,
    }


def test_counting_an_import_shuffles_hashes_not_rows(spark, lines):
    batch = lines.select("row_hash", F.col("id").alias("seq"), F.lit("X").alias("disposition"))
    stored = batch.limit(0).select("row_hash", "disposition")
    counts = op.upsert_counts(stored, batch)
    distinct = 2 * (ROWS // 3) + PARTS
    assert shuffled_records(counts) <= 3 * distinct + 100
    assert counts.first().asDict() == {"added": 2 * (ROWS // 3) + 1, "updated": 0, "skipped": ROWS // 3 - 1}
