from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from checks import oracles
from checks.compare import connect, differences
from checks.queries import queries as own_queries

QUERIES, SQL = own_queries(), oracles.oracle_sql()
SLOW_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "PythonUDF")


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    """Same rows as the SQL, from a plan without cross joins and Python workers."""
    df = QUERIES[name](spark, folder)
    rows, problem = differences(df, con, SQL[name])
    assert problem is None
    assert rows > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [node for node in SLOW_NODES if node in plan] == []


@pytest.fixture(scope="module")
def shuffled(spark, folder, tmp_path_factory):
    """The same tables with the rows of the line items in other files and another order."""
    root = tmp_path_factory.mktemp("shuffled")
    for path in Path(folder).glob("*.parquet"):
        (root / path.name).symlink_to(path)
    (root / "lineitem.parquet").unlink()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    lines.repartition(7, F.xxhash64("l_partkey", "l_extendedprice")).write.parquet(str(root / "lineitem.parquet"))
    return str(root)


TIES = ("insert_ignore_batch", "insert_ignore", "first_by_hash", "dedup_orders", "dedup_returns", "upsert_disposition", "import_orders")


@pytest.mark.parametrize("name", TIES)
def test_order_of_input_makes_no_difference(spark, con, shuffled, name):
    for partitions in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert differences(QUERIES[name](spark, shuffled), con, SQL[name])[1] is None
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ids_tell_lines_apart(spark, con, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert QUERIES["all_orders"](spark, folder).select("id").distinct().count() == rows
