import json

import pytest
from pyspark.sql import functions as F

from backhaul import plans, schema
from backhaul.sources import (
    SnapshotTable,
    read_orders_payload,
    read_returns_payload,
    read_typed_sheet,
    upload_history,
    write_csv,
)
from backhaul.streaming import stream_ingest

HEADER = "Identifier,purchase-date,Brand,amazon-order-id,order-status,sku,asin,quantity,item-price"


def order(i, date="2024-01-05", price="10.50"):
    return f"id{i},{date},B,o{i},Shipped,s{i},a{i},2,{price}"


def write(path, lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


@pytest.fixture
def tables(spark, tmp_path):
    return plans.open_tables(spark, str(tmp_path / "tables"))


def test_loading_again_adds_nothing(spark, tmp_path, tables):
    path = write(tmp_path / "a.csv", [order(1), order(2), order(1), order(3, "5/1/2024"), order(4, "")])
    first = plans.load_sheet_file(spark, tables, path)
    again = plans.load_sheet_file(spark, tables, path)
    assert first == {"orders": {"added": 4, "skipped": 1}}
    assert again == {"orders": {"added": 0, "skipped": 5}}
    rows = tables.orders.read()
    assert rows.count() == 4 == rows.select("id").distinct().count()
    assert {r["purchase_ym"] for r in rows.collect()} == {"2024-01", None}
    assert rows.schema.names == schema.ORDERS.names
    # logged once, because the file is the same
    log = upload_history(tables.log.read()).collect()
    assert [(r["filename"], r["rows_added"], r["rows_skipped"]) for r in log] == [("a.csv", 4, 1)]


def test_first_row_of_a_hash_wins(spark, tmp_path, tables):
    path = write(tmp_path / "a.csv", [order(1), order(1).replace("Shipped", "Cancelled")])
    plans.load_sheet_file(spark, tables, path, multiline=True)
    assert [r["order_status"] for r in tables.orders.read().collect()] == ["Shipped"]


def test_workbook_with_both_sheets(spark, tmp_path, tables):
    sheets = {
        "All Orders Raw": write(tmp_path / "o.csv", [order(1)]),
        "Return Raw": write(
            tmp_path / "r.csv", ["2024-02-01,o1,a1,SELLABLE,R"], "Return Date,Order ID,ASIN,Detailed-disposition,Reason"
        ),
    }
    counts = plans.load_workbook(spark, tables, sheets, "both", "book.xlsx")
    assert counts == {"orders": {"added": 1, "skipped": 0}, "returns": {"added": 1, "skipped": 0}}
    month = plans.monthly_summary(tables.orders.read(), tables.returns.read()).first()
    assert (month["month"], month["order_units"], month["return_units"]) == ("2024-01", 2, 1)


def test_orders_payload(spark, tmp_path, tables):
    record = {"identifier": "i", "purchase_date": "2024-03-01", "quantity": 2, "item_price": 9.99, "row_hash": "h1"}
    path = tmp_path / "body.json"
    path.write_text(json.dumps({"rows": [record, {**record, "quantity": 5}, {**record, "row_hash": None}]}))
    rows = read_orders_payload(spark, str(path), wrapped=True, multiline=True)
    assert plans.load_payload(tables, rows, "orders") == {"added": 2, "skipped": 1}
    stored = {r["row_hash"]: r for r in tables.orders.read().collect()}
    assert stored["h1"]["quantity"] == 2 and str(stored["h1"]["item_price"]) == "9.99"
    assert stored["h1"]["purchase_ym"] == "2024-03"


def test_returns_payload_fills_blank_dispositions(spark, tmp_path, tables):
    def body(*pairs):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        lines = [{"row_hash": h, "disposition": d, "return_date_parsed": "May", "quantity": 1} for h, d in pairs]
        path.write_text("\n".join(json.dumps(x) for x in lines))
        return read_returns_payload(spark, str(path))

    first = plans.load_payload(tables, body(("a", ""), ("b", "X"), ("a", "")), "returns")
    assert first == {"added": 2, "updated": 1, "skipped": 0}
    second = plans.load_payload(tables, body(("b", "Y"), ("a", ""), ("a", "Z"), ("a", "W"), ("c", None)), "returns")
    assert second == {"added": 1, "updated": 2, "skipped": 2}
    stored = {r["row_hash"]: r["disposition"] or "" for r in tables.returns.read().collect()}
    assert stored == {"a": "Z", "b": "X", "c": ""}
    assert {r["return_month"] for r in tables.returns.read().collect()} == {"May"}


def test_snapshots_are_read_only_when_complete(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), schema.UPLOAD_LOG)
    row = [("1", "f", "h", "orders", 1, 0, "me", None)]
    assert table.read().count() == 0
    table.replace(spark.createDataFrame(row, schema.UPLOAD_LOG))
    (tmp_path / "t" / "snapshot-00000002").mkdir()  # a writer that died
    assert table.read().count() == 1
    table.append(spark.createDataFrame(row, schema.UPLOAD_LOG))
    assert table.read().count() == 2
    assert table.truncate() == 2
    assert table.read().count() == 0 and table.current().endswith("snapshot-00000003")


def test_truncate_reports_counts(spark, tmp_path, tables):
    plans.load_sheet_file(spark, tables, write(tmp_path / "a.csv", [order(1), order(2)]))
    assert tables.truncate() == {"orders": 2, "returns": 0, "log": 1}
    assert plans.load_sheet_file(spark, tables, str(tmp_path / "a.csv"))["orders"]["added"] == 2


def test_csv_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"')], "`Product` STRING, `Customer Comment` STRING")
    write_csv(df, str(tmp_path / "out"), quote_all=True, single_file=True)
    part = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert part == '"Product","Customer Comment"\n"a,b","say ""x"""\n'


def test_stream_equals_batch(spark, tmp_path, tables):
    source = tmp_path / "incoming"
    source.mkdir()
    one, two = [order(i) for i in range(50)], [order(i) for i in range(25, 80)]
    write(source / "1.csv", one)

    def run():
        stream_ingest(
            spark, str(source), HEADER.split(","), tables, str(tmp_path / "ck"), max_files_per_trigger=1
        ).awaitTermination()

    run()
    assert tables.orders.read().count() == 50
    write(source / "2.csv", two)
    run()
    run()  # nothing new
    batch = plans.open_tables(spark, str(tmp_path / "batch"))
    plans.load_sheet_file(spark, batch, write(tmp_path / "all.csv", one + two))
    columns = [c for c in schema.ORDERS.names if c != "id"]
    streamed, loaded = tables.orders.read().select(columns), batch.orders.read().select(columns)
    assert streamed.exceptAll(loaded).count() == 0 == loaded.exceptAll(streamed).count()
    log = tables.log.read().orderBy("uploaded_at").select("rows_added", "rows_skipped").collect()
    assert [tuple(r) for r in log] == [(50, 0), (30, 25)]


def test_months_are_partitions(spark, tmp_path, tables):
    rows = [order(i, f"2024-0{1 + i % 3}-05") for i in range(30)]
    plans.load_sheet_file(spark, tables, write(tmp_path / "a.csv", rows))
    month = tables.orders.read().filter(F.col("purchase_ym") == "2024-02")
    assert month.count() == 10
    assert "PartitionFilters: [isnotnull(purchase_ym" in month._jdf.queryExecution().executedPlan().toString()


def test_maintenance_rewrites_the_table(spark, tmp_path, tables):
    rows = [order(1), order(1, price="11"), order(2), ",,,,,s,a9,1,5", "x" + order(2)]
    plans.load_sheet_file(spark, tables, write(tmp_path / "a.csv", rows))
    assert plans.maintain(tables, "cleanup_bad_orders") == {"deleted": 1, "remaining": 4}
    assert plans.maintain(tables, "dedup_orders") == {"deleted": 2, "remaining": 2}
    assert plans.maintain(tables, "dedup_orders") == {"deleted": 0, "remaining": 2}
    kept = {r["amazon_order_id"]: (r["identifier"], float(r["item_price"])) for r in tables.orders.read().collect()}
    assert kept == {"o1": ("id1", 10.5), "o2": ("id2", 10.5)}  # the first to arrive


def test_typed_sheets_load_like_text(spark, tmp_path):
    typed = spark.sql(
        "SELECT 'i' AS Identifier, 'a' AS asin, DATE'2024-01-05' AS `Purchase Date2`, "
        "CAST(19.0 AS DOUBLE) AS `item-price`, 2 AS quantity, 's' AS sku"
    )
    typed.write.parquet(str(tmp_path / "typed"))
    tables = plans.open_tables(spark, str(tmp_path / "tables"))
    assert plans.load_sheet(tables, read_typed_sheet(spark, str(tmp_path / "typed")))["added"] == 1
    text = write(tmp_path / "t.csv", ["i,a,2024-01-05,19,2,s"], "Identifier,asin,Purchase Date2,item-price,quantity,sku")
    assert plans.load_sheet_file(spark, tables, text) == {"orders": {"added": 0, "skipped": 1}}
    row = tables.orders.read().first()
    assert (row["purchase_date"], row["quantity"], float(row["item_price"])) == ("2024-01-05", 2, 19.0)


def test_staged_copies_are_removed(spark, tmp_path, tables):
    from backhaul.session import scratch_root
    from backhaul.sources import list_files

    plans.load_sheet_file(spark, tables, write(tmp_path / "a.csv", [order(1)]))
    assert not [n for n in list_files(spark, scratch_root(spark)) if n.startswith("staged-")]


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def returns_body(spark, path, rows):
    lines = [{"row_hash": h, "disposition": d, "return_date": date, "quantity": 1} for h, d, date in rows]
    path.write_text("\n".join(json.dumps(x) for x in lines))
    return read_returns_payload(spark, str(path))


def test_a_load_that_died_is_not_read(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), schema.UPLOAD_LOG)
    row = spark.createDataFrame([("1", "f", "h", "orders", 1, 0, "me", None)], schema.UPLOAD_LOG)
    table.replace(row)
    table.append(row)
    (tmp_path / "t" / "snapshot-00000001" / "load=2" / "_SUCCESS").unlink()
    assert table.read().count() == 1
    table.append(row)  # a new folder, beside the one that died
    assert table.read().count() == 2


def test_an_import_that_fills_nothing_writes_nothing(spark, tmp_path, tables):
    rows = [("a", "", "2024-01-05"), ("b", "X", "2024-02-05")]
    plans.load_payload(tables, returns_body(spark, tmp_path / "1.json", rows), "returns")
    before = files_of(tmp_path / "tables")
    again = plans.load_payload(tables, returns_body(spark, tmp_path / "2.json", rows), "returns")
    assert again == {"added": 0, "updated": 1, "skipped": 1}
    assert files_of(tmp_path / "tables") == before


def test_one_fill_rewrites_one_month(spark, tmp_path, tables):
    rows = [(f"h{i}", "" if i % 2 else "X", f"2024-0{1 + i % 5}-05") for i in range(20)] + [("odd", "", "5/1/2024")]
    plans.load_payload(tables, returns_body(spark, tmp_path / "1.json", rows), "returns")
    before = files_of(tmp_path / "tables")
    counts = plans.load_payload(tables, returns_body(spark, tmp_path / "2.json", [("h1", "NEW", "2024-02-05")]), "returns")
    assert counts == {"added": 0, "updated": 1, "skipped": 0}
    after = files_of(tmp_path / "tables")
    changed = {k.split("/")[-2] for k in before.keys() ^ after.keys()}
    assert changed == {"return_ym=2024-02"}
    stored = {r["row_hash"]: r["disposition"] or "" for r in tables.returns.read().collect()}
    assert stored == {h: d for h, d, _ in rows} | {"h1": "NEW"}


def test_maintenance_touches_months_with_a_removed_row_only(spark, tmp_path, tables):
    rows = [order(i, f"2024-0{1 + i % 3}-05") for i in range(9)]
    plans.load_sheet_file(spark, tables, write(tmp_path / "a.csv", rows))
    plans.load_sheet_file(spark, tables, write(tmp_path / "b.csv", ["again" + order(4, "2024-02-05"), ",,,,,s,a9,1,5"]))
    before = files_of(tmp_path / "tables" / "orders")
    assert plans.maintain(tables, "dedup_orders") == {"deleted": 1, "remaining": 10}
    after = files_of(tmp_path / "tables" / "orders")
    # the second load's February held nothing else, so its folder is gone
    assert {k.split("/", 1)[1].rsplit("/", 1)[0] for k in before.keys() ^ after.keys()} == {"load=2/purchase_ym=2024-02"}
    assert plans.maintain(tables, "cleanup_bad_orders") == {"deleted": 1, "remaining": 9}
    assert plans.maintain(tables, "cleanup_bad_orders") == {"deleted": 0, "remaining": 9}
    assert {r["identifier"] for r in tables.orders.read().collect()} == {f"id{i}" for i in range(9)}


def test_files_of_a_load_follow_their_path(spark, tmp_path, tables):
    (tmp_path / "parts").mkdir()
    for n in ("10", "2", "1"):
        write(tmp_path / "parts" / f"{n}.csv", [order(f"{n}-{i}") for i in range(3)])
    plans.load_sheet_file(spark, tables, str(tmp_path / "parts"))
    found = [r["identifier"] for r in tables.orders.read().orderBy("id").collect()]
    assert found == [f"id{n}-{i}" for n in ("1", "10", "2") for i in range(3)]
