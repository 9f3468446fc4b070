"""What the operators share: written intermediates and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root
from ..sources.files import hadoop_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session limited to a few megabytes.

    Spark counts rows (10,000) and bytes (64 MB); with texts that means large buffers in
    the JVM and large lists in Python, several at a time. A longer row is its own batch.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared scratch folder and read back.

    It cuts the lineage (a lost executor costs no recomputation), and both sides of a
    later join are plain scans, so Spark knows their size and AQE can split hot keys.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FAN = 16
PART = "part long, data binary"


def of_tasks(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], bytes], fold: Callable[[list[bytes]], bytes]) -> bytes:
    """``fold`` of what ``work`` makes of each task's rows, in the order of the tasks.

    ``FAN`` results at a time are folded in tasks until so few are left, and those on the driver.
    """

    def in_task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = work(b for b in frames if b.num_rows)
        yield _part(TaskContext.get().partitionId(), data)

    def of_few(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        return pa.Table.from_batches([_part(rows.column("part")[0].as_py() // FAN, fold(rows.column("data").to_pylist()))])

    parts = written(df.mapInArrow(in_task, PART), "parts")
    while parts.count() > FAN:
        fewer = written(parts.groupBy(F.expr(f"part div {FAN}").alias("few")).applyInArrow(of_few, PART), "parts")
        forget(parts)
        parts = fewer
    last = [bytes(data) for _, data in sorted((r["part"], r["data"]) for r in parts.collect())]
    forget(parts)
    return fold(last)


def _part(number: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["part", "data"])


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a column that has a different long in every row, and its name.

    The key is a row's file and place therein, so every read of it, in whatever splits,
    gives the same. What is not a plain scan of Parquet files is written first.
    """

    def places(scan: DataFrame) -> list[Column]:
        meta = scan.metadataColumn("_metadata")
        return [meta["file_path"].alias(f"{key}_path"), meta["row_index"].alias(f"{key}_at")]

    key = "row_key"
    while any(c.lower().startswith(key) for c in df.columns):
        key += "_"
    plain = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    try:
        plain = plain and bool(df.select(*places(df)).columns)
    except AnalysisException:  # other formats do not number their rows
        plain = False
    scan = df if plain else written(df, "keyed")
    paths = sorted(r[0] for r in scan.select(places(scan)[0]).distinct().collect())  # the names of its files
    files = df.sparkSession.createDataFrame(list(enumerate(paths)), f"{key}_file long, {key}_path string")
    number = F.shiftleft(f"{key}_file", 36) + F.col(f"{key}_at")
    keyed = scan.select("*", *places(scan)).join(F.broadcast(files), f"{key}_path", "left")
    return keyed.select(*[f"`{c}`" for c in df.columns], number.alias(key)), key


def row_order(doc_id: Column, key: Column, no_id: int) -> Column:
    """Rows by id, then by row key, as one number of fixed width; null ids stand at ``no_id``."""
    first = F.coalesce(doc_id.cast("decimal(19,0)"), F.lit(Decimal(no_id)).cast("decimal(19,0)"))
    return (first * F.lit(Decimal(10**19)).cast("decimal(20,0)") + key).cast("decimal(38,0)")


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        fs, target = hadoop_path(df.sparkSession, path)
        fs.delete(target, True)


def ascii_lower(column):
    """A-Z to a-z and nothing else; ``lower`` would fold other letters too."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round: every node hands the smallest node it knows to its neighbours.

    The minimum combines before the shuffle. It is written, so the join back to the
    edges of a hot node is one that AQE can split.
    """
    if large:
        around = edges.union(edges.select("b", "a"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = written(least, "least")
        out = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(around.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = around.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    result = written(out.where("a <> b").distinct(), "star")
    forget(least)
    return result


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has two columns of longs. Alternating large and small stars: the number
    of edges never grows, and rounds are logarithmic in the longest path. What goes
    through the driver per round is one count and one checksum.
    """
    first, second = edges.columns
    now = written(
        edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
        .where("a <> b")
        .distinct(),
        "star",
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    while before[0]:
        wide = _star(now, True)
        new = _star(wide, False)
        forget(wide)
        forget(now)
        after, now = mark(new), new
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
