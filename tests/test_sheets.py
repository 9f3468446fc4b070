import pytest

from backhaul import operators as op
from backhaul import plans
from backhaul.sources import detect_kind, file_md5, fingerprint, read_sheet, read_workbook, route
from backhaul.sources.sheets import Sheet, breaks_in_quotes, trim_headers
from backhaul.streaming import stream_ingest

RETURNS_CSV = '''Return Date2 , Reason,reason,Order ID,ASIN,Quantity,Detailed-disposition,Customer-comments
2024-01-05T10:00:00+00:00,, TOO_SMALL ,o1 ,A1,0,SELLABLE,"said ""no"",
twice"
45296.75,DEFECTIVE,ignored,o2,A2,3,,
5/1/2024,,,o3,A3,,X,
'''


@pytest.fixture
def returns_file(tmp_path):
    path = tmp_path / "returns.csv"
    path.write_text(RETURNS_CSV)
    return str(path)


def test_headers_may_differ_in_case_only(spark, returns_file):
    rows = {r["order_id"]: r for r in op.normalize_returns(read_sheet(spark, returns_file, multiline=True)).collect()}
    assert rows["o1"]["reason"] == "TOO_SMALL"  # Reason is empty, reason is filled
    assert rows["o2"]["reason"] == "DEFECTIVE"  # Reason comes first
    assert rows["o1"]["customer_comments"] == 'said "no",\ntwice'
    assert rows["o1"]["quantity"] == 1 and rows["o2"]["quantity"] == 3
    assert rows["o1"]["return_date"] == rows["o2"]["return_date"] == "2024-01-05"
    assert rows["o1"]["return_month"] == "January 2024" and rows["o1"]["return_year"] == "2024"
    assert rows["o3"]["return_date"] == "5/1/2024"
    assert rows["o3"]["return_week"] is None and rows["o3"]["return_month"] == ""


def test_arrival_order_is_file_order(spark, tmp_path):
    path = tmp_path / "orders.tsv"
    path.write_text("sku\tasin\n" + "".join(f"s{i}\ta\n" for i in range(1000)))
    sheet = read_sheet(spark, str(path), multiline=False)
    found = [r["sku"] for r in op.normalize_orders(sheet).orderBy("seq").collect()]
    assert found == [f"s{i}" for i in range(1000)]


def test_orders_aliases_and_hash_date(spark):
    df = spark.createDataFrame(
        [("", "dup ", "45296", "2024-01-06", "x", "0.00", "$5.00", "n/a")],
        ["Identifier", " Duplicate Id", "Purchase Date2", "purchase-date", "asin", "item-price", "item-tax", "quantity"],
    )
    row = op.normalize_orders(Sheet.of(df)).first()
    assert row["identifier"] == "dup"
    assert row["purchase_date"] == "2024-01-05"  # first alias, a day serial
    assert row["quantity"] == 0
    assert float(row["item_price"]) == 0 and float(row["item_tax"]) == 5
    import hashlib

    # raw identifier, raw asin, the date under the other alias, and no zero price
    assert row["row_hash"] == hashlib.md5(b"dup |x|2024-01-06|").hexdigest()


def test_typed_sheets_hash_like_text(spark):
    typed = spark.createDataFrame([("i", "a", 19.0), ("i", "a", 0.0)], ["Identifier", "asin", "item-price"])
    text = spark.createDataFrame([("i", "a", "19"), ("i", "a", "")], ["Identifier", "asin", "item-price"])
    hashes = [[r["row_hash"] for r in op.normalize_orders(Sheet.of(d)).collect()] for d in (typed, text)]
    assert hashes[0] == hashes[1]


def test_missing_columns_are_blank(spark):
    row = op.normalize_orders(Sheet.of(spark.createDataFrame([("s",)], ["sku"]))).first()
    assert row["brand"] == "" and row["purchase_date"] is None and row["item_price"] is None
    assert row["quantity"] == 0 and row["purchase_ym"] is None


def test_trim_headers(spark):
    df = trim_headers(spark.createDataFrame([("x", None)], " a STRING, b STRING".replace(" a", "`  a `")))
    assert df.columns == ["a", "b"] and df.first() == ("x", "")


@pytest.mark.parametrize(
    "headers, kind",
    [
        (["Return Date2", "x"], "returns"),
        (["detailed-disposition"], "returns"),
        (["RETURN MONTH "], "returns"),
        (["amazon-order-id"], "orders"),
        ([], "orders"),
    ],
)
def test_detect_kind(headers, kind):
    assert detect_kind(headers) == kind


@pytest.mark.parametrize(
    "names, kind, plan",
    [
        (["All Orders Raw", "Return Raw"], "auto", {"orders": "All Orders Raw", "returns": "Return Raw"}),
        (["Return Raw", "All Orders Raw"], "orders", {"orders": "All Orders Raw", "returns": "Return Raw"}),
        (["All Orders Raw"], "returns", {"orders": "All Orders Raw"}),
        (["Return Raw"], "orders", {"orders": "Return Raw", "returns": "Return Raw"}),
        (["Sheet1", "Sheet2"], "orders", {"orders": "Sheet1"}),
        (["Sheet1", "Sheet2"], "returns", {"returns": "Sheet1"}),
        (["Sheet1", "Sheet2"], "auto", {"auto": "Sheet1"}),
        ([], "auto", {}),
    ],
)
def test_route(names, kind, plan):
    assert route(names, kind) == plan


def test_read_workbook_detects_the_kind(spark, returns_file):
    assert list(read_workbook(spark, {"Sheet1": returns_file})) == ["returns"]


def test_file_md5(spark, returns_file):
    import hashlib

    assert file_md5(spark, returns_file) == hashlib.md5(RETURNS_CSV.encode()).hexdigest()
    assert fingerprint(spark, returns_file) == file_md5(spark, returns_file)


def test_fingerprint_of_a_folder(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "1.csv").write_text("x\ny\n")
        (tmp_path / n / "2.csv").write_text("x\n")
    same = fingerprint(spark, str(tmp_path / "a"))
    assert same == fingerprint(spark, str(tmp_path / "b"))
    (tmp_path / "b" / "2.csv").write_text("x\nx\n")
    assert same != fingerprint(spark, str(tmp_path / "b"))


def test_file_md5_beyond_two_gigabytes(spark, tmp_path):
    import hashlib

    path = tmp_path / "large"
    with path.open("wb") as file:  # a hole, which takes no space
        file.truncate((1 << 31) + 5)
    expected = hashlib.md5()
    for _ in range(1 << 7):
        expected.update(bytes(1 << 24))
    expected.update(bytes(5))
    assert file_md5(spark, str(path)) == expected.hexdigest()


def test_line_breaks_in_quotes_are_found(spark, returns_file, tmp_path):
    rows = {r["order_id"]: r for r in op.normalize_returns(read_sheet(spark, returns_file)).collect()}
    assert set(rows) == {"o1", "o2", "o3"} and rows["o1"]["customer_comments"] == 'said "no",\ntwice'
    cases = ['a,b\n1,"x ""y"""\n', 'a,b\n5" x,"y\nz"\n', 'a,b\n"1,2",""\n', 'a,b\n"","u\n\nv"\n']
    found = []
    for i, text in enumerate(cases):
        (tmp_path / f"{i}.csv").write_text(text)
        found.append(breaks_in_quotes(spark, str(tmp_path / f"{i}.csv"), ","))
    assert found == [False, True, False, True]


def test_streamed_line_breaks_in_quotes(spark, returns_file, tmp_path):
    folder = tmp_path / "in [1] a"
    folder.mkdir()
    (folder / "r 1.csv").write_text(RETURNS_CSV)
    headers = RETURNS_CSV.split("\n")[0].split(",")
    tables = plans.open_tables(spark, str(tmp_path / "tables"))
    source = str(tmp_path / "in*")
    stream_ingest(spark, source, headers, tables, str(tmp_path / "check")).awaitTermination()
    rows = {r["order_id"]: r["customer_comments"] for r in tables.returns.read().collect()}
    assert set(rows) == {"o1", "o2", "o3"} and rows["o1"] == 'said "no",\ntwice'
