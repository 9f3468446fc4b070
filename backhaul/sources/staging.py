"""Written intermediates for rows that are read several times."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..session import scratch_root
from .paths import hadoop_path

COMPRESSION = "zstd"  # hashes as hexadecimal text take half of what snappy leaves of them


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written once to the shared scratch folder, to be read while in the block.

    Loading a batch decides on it, counts it and writes it. From the written copy each
    of these reads only its columns, parsing is done once, an executor lost half-way
    costs no parsing again, and a join with it has a plain scan on this side, which
    AQE can split where a key is hot. The copy goes when the block ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/staged-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", COMPRESSION).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        fs, target = hadoop_path(spark, path)
        fs.delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared scratch folder, until ``forget`` is called on the result."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        fs, target = hadoop_path(df.sparkSession, path)
        fs.delete(target, True)
