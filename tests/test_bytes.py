"""What loading and maintenance shuffle and write: short lists, no whole rows where files will do."""

from pyspark.sql import functions as F

from backhaul import plans
from backhaul.functions.hashing import packed_hash
from backhaul.operators import upsert
from backhaul.plans.load import _filled_months, numbered
from backhaul.plans.maintain import OPERATIONS, _months
from backhaul.sources import read_returns_payload
from backhaul.sources.files import content_hash
from backhaul.sources.paths import list_files
from checks.queries import export_sheet
from backhaul.sources.star import batch_rows, line_batches, order_batches, raw_returns, return_batches

HEADER = "Return Date,Order ID,ASIN,Detailed-disposition,Reason"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def returns_of(spark, tmp_path, *rows):
    tables = plans.open_tables(spark, str(tmp_path / "tables"))
    path = tmp_path / "r.csv"
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    plans.load_sheet_file(spark, tables, str(path))
    return tables


def test_packed_hashes_tell_texts_apart(spark):
    md5 = "0f" * 16
    texts = [md5, md5.upper(), "\x0f" * 16, "", "\0", "\0" * 17, "x", md5 + "0", md5[:-1], md5 + "\n"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, None, "x"]], "h string")
    packed = df.select("h", packed_hash("h").alias("p")).distinct().collect()
    assert len({bytes(r["p"]) for r in packed if r["h"] is not None}) == len(texts)
    assert [r["p"] for r in packed if r["h"] is None] == [None]
    assert len(next(r["p"] for r in packed if r["h"] == md5)) == 16


def test_sheets_are_written_in_order_and_compressed(spark, folder, tmp_path):
    path = f"{tmp_path}/returns.csv"
    export_sheet(spark, raw_returns(spark, folder, in_order=True), path)
    parts = [n for n in list_files(spark, path) if n.startswith("part-")]
    assert parts and all(n.endswith(".gz") for n in parts)
    plain = f"{tmp_path}/plain.csv"
    spark.read.text(path).coalesce(1).write.text(plain)
    assert content_hash(spark, path) == content_hash(spark, plain)


def test_ordered_batches_hold_the_same_rows(spark, folder):
    for plain, ordered in zip(return_batches(spark, folder), return_batches(spark, folder, in_order=True)):
        rows = [tuple(r) for r in ordered.collect()]
        assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in plain.collect())
        assert [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_rows_pass_from_file_to_file(spark, tmp_path):
    tables = returns_of(
        spark, tmp_path, "2024-01-02,o1,a1,,R", "2024-01-03,o2,a2,SELLABLE,R", "2024-02-01,o3,a3,SELLABLE,R", ",o4,a4,,R"
    )
    table = tables.returns
    kind, keep, _ = OPERATIONS["cleanup_empty_disposition"]
    touched = table.read_placed().select(*table.places).distinct()
    assert "hashpartitioning(id" not in plan(keep(_months(table, touched)))
    assert plans.maintain(tables, "cleanup_empty_disposition") == {"deleted": 2, "remaining": 2}
    assert {(r["order_id"], r["return_ym"]) for r in table.read().collect()} == {("o2", "2024-01"), ("o3", "2024-02")}
    folder = table.current()
    assert not [n for load in list_files(spark, folder) for n in list_files(spark, f"{folder}/{load}") if "HIVE_DEFAULT" in n]
    assert all(".zstd." in f or ".zst." in f for f in table.read().inputFiles())


def test_only_blank_rows_of_a_month_are_looked_up(spark, tmp_path):
    table = returns_of(spark, tmp_path, "2024-01-02,o1,a1,,R", "2024-01-03,o2,a2,SELLABLE,R", "2024-02-03,o5,a2,,R").returns
    filled = table.read_placed().filter(F.col("order_id") == "o1").select("id", F.lit("DEFECTIVE").alias("fill"), *table.places)
    months, _ = _filled_months(table, filled, F.coalesce("disposition", F.lit("")) == "")
    assert {(r["order_id"], r["disposition"]) for r in months.collect()} == {("o1", "DEFECTIVE"), ("o2", "SELLABLE")}


def test_rows_are_added_by_their_numbers(spark):
    """The same rows as by joining whole rows with the state of their hashes."""
    rows = [("h1", 1, ""), ("h1", 2, "A"), ("h2", 3, "B"), ("h2", 4, "C"), ("h3", 5, None), (None, 6, ""), ("h4", 7, ""), (None, 8, "D")]
    batch = spark.createDataFrame(rows, "row_hash string, seq int, disposition string")
    batch = spark.createDataFrame(numbered(batch).collect(), numbered(batch).schema)
    stored = spark.createDataFrame([("h4", "")], "row_hash string, disposition string")
    state = upsert.hash_state(stored, batch, "_at")
    lists = upsert.left_out(batch, state, "_at"), upsert.late_fills(state)
    found = upsert.added_rows(batch, state, "_at", lists)
    assert found.columns == batch.columns
    want = [("h1", 1, "A"), ("h2", 3, "B"), ("h3", 5, None), (None, 6, ""), (None, 8, "D")]
    assert sorted((r["seq"], r["row_hash"], r["disposition"]) for r in found.collect()) == [(n, h, d) for h, n, d in want]
    by_state = upsert.added_rows(batch, state, "_at")
    assert {r["seq"] for r in by_state.collect()} == {n for _, n, _ in want}


def test_import_fills_and_adds(spark, tmp_path):
    tables = plans.open_tables(spark, str(tmp_path / "tables"))
    for n, lines in enumerate(
        (
            ['{"order_id":"o1","return_date":"2024-01-02","row_hash":"h1","disposition":""}',
             '{"order_id":"o2","return_date":"2024-01-05","row_hash":"h2","disposition":"SELLABLE"}'],
            ['{"order_id":"o1","return_date":"2024-01-02","row_hash":"h1","disposition":"DEFECTIVE"}',
             '{"order_id":"o3","return_date":"2024-03-05","row_hash":"h3"}',
             '{"order_id":"o3","return_date":"2024-03-05","row_hash":"h3","disposition":"LATE"}'],
        )
    ):
        path = tmp_path / f"{n}.json"
        path.write_text("\n".join(lines) + "\n")
        counts = plans.load_payload(tables, read_returns_payload(spark, str(path)), "returns")
    # the hash is known and blank when filled; the later row of an inserted blank one updates it
    assert counts == {"added": 1, "updated": 2, "skipped": 0}
    rows = {(r["order_id"], r["disposition"]) for r in tables.returns.read().collect()}
    assert rows == {("o1", "DEFECTIVE"), ("o2", "SELLABLE"), ("o3", "LATE")}


def test_batches_as_lines_make_the_same_rows(spark, folder):
    for rows, lines in zip(order_batches(spark, folder), line_batches(spark, folder)):
        made = batch_rows(lines)
        assert made.schema == rows.schema
        assert sorted(map(str, made.collect())) == sorted(map(str, rows.collect()))
        assert {len(r[0]) for r in lines.select("row_hash").collect()} == {16}
        assert "BroadcastHashJoin" not in plan(lines) and "SortMergeJoin" not in plan(lines)  # one written copy
