import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from backhaul import operators as op
from backhaul import plans
from backhaul.sources import star


def brute_import(stored, batch):
    """Row by row, as a transaction would do it."""
    table, actions = dict(stored), []
    for seq, key, disposition in batch:
        if key is None:
            actions.append((seq, "added"))
        elif key not in table:
            table[key] = disposition
            actions.append((seq, "added"))
        elif not table[key]:
            table[key] = disposition
            actions.append((seq, "updated"))
        else:
            actions.append((seq, "skipped"))
    return table, actions


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upsert_against_brute_force(spark, seed):
    rng = random.Random(seed)
    values = ["", "", None, "X", "Y"]
    stored = [(f"k{i}", rng.choice(values)) for i in range(10)]
    # one hash holds a third of the batch
    keys = [None, *[f"k{i}" for i in range(20)]] + ["k3", "k15"] * 6
    batch = [(i, rng.choice(keys), rng.choice(values)) for i in range(200)]
    table, actions = brute_import(stored, batch)

    stored_df = spark.createDataFrame(stored, "row_hash STRING, disposition STRING")
    batch_df = spark.createDataFrame(batch, "seq INT, row_hash STRING, disposition STRING").repartition(5)
    found = op.upsert_actions(stored_df, batch_df).select("seq", "action").collect()
    assert sorted(map(tuple, found)) == actions

    counts = op.upsert_counts(stored_df, batch_df).first().asDict()
    assert counts == {a: sum(x == a for _, x in actions) for a in ("added", "updated", "skipped")}

    after = op.upsert_disposition(stored_df, batch_df).collect()
    assert {r[0]: r[1] or "" for r in after if r[0]} == {k: v or "" for k, v in table.items()}
    assert sum(r[0] is None for r in after) == sum(k is None for _, k, _ in batch)


def test_counts_add_up_and_loading_is_idempotent(spark, folder):
    first, second = star.order_batches(spark, folder, with_part=False)
    stored = op.first_by_hash(first, ["id"])
    counts = op.ingest_actions(stored, second, "id").first()
    assert counts["added"] + counts["skipped"] == second.count()
    table = stored.unionByName(op.insert_ignore(second, stored, ["id"]))
    assert op.insert_ignore(second, table, ["id"]).count() == 0


BLANKS = [None, "", " ", "-", "x"]


def test_dedup_keeps_rows_outside_the_scope(spark):
    rows = [(f"{i}{j}", a, b, None, "2024-01-01") for i, a in enumerate(BLANKS) for j, b in enumerate(BLANKS)]
    rows += [(f"z{r[0]}", *r[1:]) for r in rows]
    df = spark.createDataFrame(
        rows, "id STRING, amazon_order_id STRING, sku STRING, item_price DOUBLE, purchase_date STRING"
    )
    kept = op.dedup_orders(df)
    outside = sum(1 for r in rows if not r[1] or not r[2])
    assert kept.count() == outside + 9
    assert op.dedup_orders(kept).count() == kept.count()


def test_dedup_prefers_priced_then_dated_then_first(spark):
    df = spark.createDataFrame(
        [
            ("1", "o", "s", 0.0, "2024-01-01"),
            ("2", "o", "s", None, "2024-01-01"),
            ("3", "o", "s", 5.0, ""),
            ("4", "o", "s", 6.0, "2024-01-01"),
            ("5", "o", "s", 7.0, "2024-01-01"),
            ("6", "p", "s", None, ""),
            ("7", "p", "s", 0.0, "2024-01-01"),
        ],
        "id STRING, amazon_order_id STRING, sku STRING, item_price DOUBLE, purchase_date STRING",
    )
    assert {r["id"] for r in op.dedup_orders(df).collect()} == {"4", "7"}


def test_dedup_returns_treats_null_reasons_as_equal(spark):
    df = spark.createDataFrame(
        [
            ("1", "o", "a", "2024-01-01", None, None),
            ("2", "o", "a", "2024-01-01", None, "X"),
            ("3", "o", "a", "2024-01-01", "", ""),
            ("4", "", "a", "2024-01-01", "", ""),
            ("5", None, "a", "2024-01-01", "", ""),
            ("6", "o", "a", "", "", ""),
        ],
        "id STRING, order_id STRING, asin STRING, return_date STRING, reason STRING, disposition STRING",
    )
    assert {r["id"] for r in op.dedup_returns(df).collect()} == {"2", "3", "4", "5", "6"}


def test_bad_orders_need_all_three_missing(spark):
    df = spark.createDataFrame(
        [("1", None, "", None), ("2", "", "", ""), ("3", None, None, "x"), ("4", " ", None, None)],
        "id STRING, amazon_order_id STRING, purchase_date STRING, order_status STRING",
    )
    assert {r["id"] for r in op.drop_bad_orders(df).collect()} == {"3", "4"}


def test_eager_aggregation_equals_the_plain_join(spark, folder):
    orders = star.order_lines(spark, folder, with_part=False)
    returns = star.return_records(spark, folder, with_part=False)
    for match_blank in (True, False):
        back = returns if match_blank else returns.filter("order_id <> ''")
        plain = (
            back.select("order_id", F.col("quantity").alias("q"))
            .join(orders, F.col("order_id") == F.col("amazon_order_id"))
            .groupBy("purchase_ym")
            .agg(F.sum("q").alias("units"))
        )
        ours = op.attribute_returns(
            returns, orders, ["purchase_ym"], {"units": F.col("quantity")}, match_blank
        )
        assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_maintenance_counts(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "disposition STRING")
    row = op.maintenance_counts(df, op.drop_blank_dispositions(df), "x").first()
    assert tuple(row) == ("x", 3, 1, 2)


def test_search_wildcards_and_case(spark):
    df = spark.createDataFrame(
        [("Blue_Hat", "s1"), ("blueXhat", "s2"), ("BLUE\nHAT", "s3"), ("été", "s4"), ("a\\b.c", "s5"), (None, "blue hat")],
        "product_name STRING, sku STRING",
    ).withColumns({c: F.lit(None).cast("string") for c in ("asin", "order_id")})

    def find(text):
        return {r["sku"] for r in op.search_returns(df, search=text).collect()}

    assert find("blue_hat") == {"s1", "s2", "s3", "blue hat"}
    assert find("b%t") == {"s1", "s2", "s3", "blue hat"}
    assert find("ÉT") == set()  # only ASCII letters fold
    assert find("\\b.") == {"s5"}
    assert find("") == {"s1", "s2", "s3", "s4", "s5", "blue hat"}


def ordered(rows):
    found = sorted(rows, key=lambda r: r[0])
    return sorted(found, key=lambda r: (r[1] is not None, r[1] or ""), reverse=True)


@pytest.mark.parametrize("short", [1, 60, 1_000_000])
def test_pages(spark, monkeypatch, short):
    monkeypatch.setattr("backhaul.operators.search.SHORT", short)
    rng = random.Random(short)
    dates = [None, "", "5/1/2024", *[f"2024-0{m}-1{d}" for m in (1, 2) for d in range(3)]]
    rows = [(f"{rng.choice('abc')}{i:04d}", rng.choice(dates + ["2024-01-11"] * 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id STRING, return_date STRING").repartition(4)
    for page in (1, 4, 10, 11):
        assert [tuple(r) for r in op.returns_page(df, page).collect()] == ordered(rows)[(page - 1) * 50 : page * 50]


def test_a_page_within_one_date_of_many_long_ids(spark, tmp_path):
    """Ids as loading makes them: long, and alike but for their ends."""
    n = 100_000
    start = "20240501T101112123456 file:/some/folder/with/a/long/path/returns.csv 0000000000000000000 "
    rows = spark.range(n).select(
        F.concat(F.lit(start), F.lpad(F.col("id").cast("string"), 19, "0")).alias("id"),
        F.lit("2024-05-01").alias("return_date"),
    )
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for page in (1, 1500, 2000, 2001):
        found = [int(r["id"][-19:]) for r in op.returns_page(stored, page).collect()]
        assert found == list(range((page - 1) * 50, min(page * 50, n)))


def test_attribution_beyond_bigint(spark):
    """One blank id with 4e18 units against three blank order lines."""
    returns = spark.createDataFrame([("", 4 * 10**18, "DEFECTIVE"), ("", 1, "SELLABLE")], "order_id STRING, quantity BIGINT, disposition STRING")
    lines = [("", "2024-01", "2024-01-05", "Shipped", 1)] * 3
    orders = spark.createDataFrame(lines, "amazon_order_id STRING, purchase_ym STRING, purchase_date STRING, order_status STRING, quantity BIGINT")
    total = 3 * (4 * 10**18 + 1)
    assert int(plans.monthly_returns(orders, returns).first()["return_units"]) == total > 2**63
    day = dt.date(2024, 2, 1)
    assert {int(r["returns_total"]) for r in plans.period_stats(orders, returns, day).collect()} == {total}
    assert int(plans.period_dispositions(orders, returns, day).first()["units"]) == total - 3
    table = {r["metric"]: r["last_month"] for r in plans.period_table(orders, returns, day).collect()}
    assert table["returns"] == float(total) and table["sellable"] == 3.0


def test_page_totals(spark, folder):
    returns = star.return_records(spark, folder)
    row = op.page_totals(returns, page=2, disposition="SELLABLE").first()
    n = returns.filter("disposition = 'SELLABLE'").count()
    assert tuple(row) == (n, 2, -(-n // 50))
