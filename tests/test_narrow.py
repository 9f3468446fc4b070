"""Loads and inserts look at rows once and shuffle hashes, not rows, to decide."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from backhaul import functions as fn
from backhaul import operators as op
from backhaul import plans
from backhaul.functions.text import BLANKS
from backhaul.operators.normalize import with_calendar
from backhaul.plans.load import placed_once, with_ids
from backhaul.sources.files import line_sums
from backhaul.sources.records import _several, read_lines
from backhaul.sources.sheets import Sheet

HEADER = "Identifier,purchase-date,amazon-order-id,order-status,sku,asin,quantity,item-price"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_rows_have_their_place_once(spark, tmp_path):
    rows = spark.createDataFrame([("h", ("f", 0, 7))], "row_hash string, seq struct<file:string, start:long, row:long>")
    assert placed_once(rows).columns == ["row_hash", "_at"]
    at = dt.datetime(2024, 1, 2)
    placed = placed_once(rows).withColumn("seq", F.col("_at")["order"])
    assert with_ids(placed, at).first()["id"] == with_ids(rows, at).first()["id"]


def test_hashes_that_are_stored_or_come_again(spark, tmp_path):
    tables = plans.open_tables(spark, str(tmp_path / "tables"))

    def load(name, *ids):
        lines = [f"{i},2024-01-0{n + 1},o{n},Shipped,s,a{i},1,{p}" for n, (i, p) in enumerate(ids)]
        path = tmp_path / name
        path.write_text("\n".join([HEADER, *lines]) + "\n")
        return plans.load_sheet_file(spark, tables, str(path))["orders"]

    assert load("a.csv", ("x", 1), ("y", 1)) == {"added": 2, "skipped": 0}
    assert load("b.csv", ("x", 1), ("y", 1), ("y", 2)) == {"added": 1, "skipped": 2}
    path = tmp_path / "c.csv"
    row = "z,2024-02-01,{},Shipped,s,a,1,5"
    path.write_text("\n".join([HEADER, row.format("first"), row.format("second"), "x,2024-01-01,o9,Shipped,s,ax,1,1"]) + "\n")
    before = tables.orders.read().count()
    counts = plans.load_sheet_file(spark, tables, str(path))["orders"]
    assert counts == {"added": 1, "skipped": 2} and tables.orders.read().count() == before + 1
    kept = tables.orders.read().filter("identifier = 'z'").collect()
    assert [r["amazon_order_id"] for r in kept] == ["first"] and kept[0]["id"]


def test_blanks_zeros_and_months(spark):
    texts = ["", " ", "a", "ab ", "\ta", "!~", "~", "\x7fa", "a\x7f", "é", " é", "x　", "﻿x", "!", "a b", "\x1f", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", fn.trimmed("t").alias("s")).collect()
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip(BLANKS)) for r in rows)
    cells = ["0", "-0", "00.", "0.00", "-0.0", "05", "-", ".0", "1", "", "0x", "/", "-5", "0.01", None]
    sheet = Sheet.of(spark.createDataFrame([(c, str(i)) for i, c in enumerate(cells)], "h string, id string"))
    kept = {r["id"]: r["v"] for r in sheet.rows.select("id", sheet.raw(["h"], zero_is_missing=True).alias("v")).collect()}
    zeros = {"0", "-0", "00.", "0.00", "-0.0"}
    assert [kept[str(i)] for i in range(len(cells))] == ["" if c is None or c in zeros else c for c in cells]
    dates = ["2024-02-30", "2024-02-29x", "0000-01-01", "2024-13-01", "5/1/2024", "", None, "2024-1-1", "2024-12-31"]
    dated = with_calendar(spark.createDataFrame([(d,) for d in dates], "d string"), "d", "p").collect()
    months = ["2024-02", "2024-02", "0000-01", None, None, None, None, None, "2024-12"]
    assert [r["p_ym"] for r in dated] == months
    assert [r["p_y"] for r in dated] == [m and m[:4] for m in months]


def test_lines_are_looked_at_once_for_their_quotes(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(_several(read_lines(spark, str(path)), ","))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan text") < text.count("Window [") and "ReusedExchange" in text
    assert text.count("RLIKE") <= 2 * text.count("FileScan text")


def test_fingerprints_sum_without_rounding(spark, tmp_path):
    lines = [f"line {i}" for i in range(500)]
    path = tmp_path / "t.txt"
    path.write_text("\n".join(lines) + "\n")
    hashes = [hashlib.md5(f"{i}:{x}".encode()).hexdigest() for i, x in enumerate(lines)]
    found = line_sums(spark, str(path)).first()
    assert found["lines"] == 500
    assert found["first"] == str(sum(int(h[:15], 16) for h in hashes))
    assert found["second"] == str(sum(int(h[15:30], 16) for h in hashes))


def test_first_rows_by_a_short_list_of_numbers(spark, tmp_path):
    rows = [("a", 2, 10), ("a", 1, 11), ("b", 5, 12), (None, 1, 13), (None, 1, 14), ("c", None, 15), ("c", 0, 16), ("d", 3, 17), ("d", 3, 18)]
    spark.createDataFrame(rows, "row_hash string, seq int, n long").write.parquet(str(tmp_path / "rows"))
    batch = spark.read.parquet(str(tmp_path / "rows"))
    again = op.repeated_hashes(batch)
    assert {r[0] for r in again.collect()} == {"a", "c", "d"}
    left_out = op.repeated_rows(batch, again, "n")
    left_out.write.parquet(str(tmp_path / "list"))
    kept = op.first_by_hash(batch, left_out=("n", spark.read.parquet(str(tmp_path / "list"))))
    assert sorted(r["n"] for r in kept.collect()) == [11, 12, 13, 14, 15, 17]
    plain = op.first_by_hash(batch).collect()
    assert sorted(r["seq"] or -1 for r in plain) == sorted(r["seq"] or -1 for r in kept.collect())
    assert "Exchange hashpartitioning" not in plan(kept)


def test_a_batch_that_is_not_small_is_not_dealt_twice(spark, tmp_path):
    rows = [("a", 1), ("b", 2), ("b", 1), (None, 4), ("e", 9)]
    spark.createDataFrame(rows, "row_hash string, seq int").write.parquet(str(tmp_path / "rows"))
    batch = spark.read.parquet(str(tmp_path / "rows"))
    stored = batch.filter("row_hash = 'a'").unionByName(batch.filter("seq = 4"))
    found = op.insert_ignore(batch, stored, small=False)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("b", 1), ("e", 9), (None, 4)], key=str)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(op.insert_ignore(batch, batch, small=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.count("Exchange hashpartitioning(row_hash") == 2
