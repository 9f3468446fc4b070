"""What the physical plans must (not) contain to hold at scale."""

import re

import pytest

from backhaul import operators as op
from backhaul import plans
from backhaul.sources import star


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_are_cut_before_the_shuffle(spark, folder):
    plan = physical(op.dedup_orders(star.order_lines(spark, folder)))
    final, partial = plan.index("row_number(), 1, Final"), plan.index("row_number(), 1, Partial")
    assert final < plan.index("Exchange hashpartitioning(amazon_order_id", final) < partial


@pytest.fixture
def loaded(spark, tmp_path, folder):
    tables = plans.open_tables(spark, str(tmp_path))
    tables.orders.replace(star.order_lines(spark, folder))
    return tables.orders


def test_a_small_batch_leaves_the_stored_table_in_place(spark, loaded):
    stored = loaded.read()
    plan = physical(op.insert_ignore(stored.limit(10), stored, ["id"]))
    semi = plan[plan.index("LeftSemi") :]
    scan = semi[: semi.index("ReadSchema: struct<row_hash:string>")]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in scan.split("BroadcastExchange")[0]


def test_a_large_batch_shuffles_whole_rows_once(spark, loaded):
    stored = loaded.read()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(op.insert_ignore(stored, stored, ["id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # the ranked rows, the stored hashes and the batch's distinct hashes
    assert plan.count("Exchange hashpartitioning(row_hash") == 3
    assert plan.count("ReadSchema: struct<row_hash:string>") == 2


def test_rollups_hash_instead_of_sorting(spark, folder):
    plan = physical(plans.daily_orders(star.order_lines(spark, folder, with_part=False)))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_report_scans_are_pruned_and_pushed(spark, loaded):
    stored = loaded.read()
    plan = physical(plans.daily_orders(stored))
    assert "PushedFilters: [IsNotNull(purchase_date), Not(EqualTo(purchase_date,))]" in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "row_hash" not in schema and "product_name" not in schema
    pushed = physical(op.dedup_orders(stored))
    assert "Or(Or(IsNull(amazon_order_id),EqualTo(amazon_order_id,))" in pushed


def test_period_months_prune_partitions(spark, loaded, folder):
    returns = star.return_records(spark, folder)
    plan = physical(plans.period_returns(loaded.read(), returns, star.AS_OF))
    filters = re.findall(r"PartitionFilters: \[(.*)", plan)
    assert any("purchase_ym" in f and " IN" in f for f in filters), filters
