"""Whitening of embeddings by a bidiagonal qd solver.

Entries become whole numbers first, so equal vectors are equal and sums are exact. The
directions come from the different vectors alone, without a covariance matrix ever being
made: each task centres its rows and reduces them, a block at a time, to the triangular
factor R of their QR decomposition; factors of ``FAN`` tasks are stacked and reduced again
until few are left. The driver makes R bidiagonal by Householder reflections, dqds finds its
singular values, and twisted factorisations the directions (``bidiagonal``). Working on R
and not on its square keeps small variances accurate.

Every row is then centred and projected in one pass, and how far the covariance of the
result is from the identity is measured in another.

Nothing that grows with the rows comes to the driver: two numbers per dimension, and a few
triangular factors. Rows are shuffled once, to find the different ones; copies
combine before that shuffle, however many there are.

Defined cases: rows whose vector is null or has a null or non-finite entry are left out, and
those with an entry of ``LARGEST`` or more, for which no exact result would fit. Shorter
vectors are filled up with zeros. Null ids and repeated rows stay. There are as many
components as the vectors have directions with any variance (16 at most), so a single
vector, equal vectors and an empty table give an empty result. Other columns are not read.
``deviation`` is exact as DECIMAL(38,0); as a long (in the query) it is null beyond its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bidiagonal import right_singular
from .common import of_tasks, small_batches, table, written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 39)
BLOCK = 4096  # rows that are reduced at once


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part: entries times SCALE, rounded down, plus SHIFT."""
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x"))


def _filled(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with vectors of one length, and that length."""
    shortest, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != longest:
        more = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(longest) - F.size("x"))
        rows = rows.withColumn("x", F.concat("x", more))
    return rows, longest or 0


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Centre:
    """Exact mean of n vectors: whole parts and what remains of the sums, below n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def around(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact: with u = x - whole it is (n u - rest)^2."""
        u = x - self.whole
        widest = int(np.abs(u).max(initial=0))
        if widest * max(widest, self.n) * max(x.shape[1], 1) >= 1 << 62:
            u, rest = u.astype(object), self.rest.astype(object)
        else:
            rest = self.rest
        squares, products = (u * u).sum(axis=1).tolist(), (u * rest).sum(axis=1).tolist()
        own, n = sum(int(r) ** 2 for r in self.rest), self.n
        return [n * (n * a - 2 * b) + own for a, b in zip(squares, products)]


def centre(different: DataFrame, size: int) -> Centre:
    """Two numbers per task and dimension are summed, so no sum leaves its type."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in frames:
            x = _matrix(batch.column(0), size)
            high += (x >> 20).sum(axis=0)
            low += (x & 0xFFFFF).sum(axis=0)
        columns = [pa.array(np.arange(size, dtype=np.int32)), pa.array(high), pa.array(low)]
        yield pa.RecordBatch.from_arrays(columns, ["at", "high", "low"])

    parts = different.select("x").mapInArrow(work, "at int, high long, low long").groupBy("at")
    sums = {r["at"]: (int(r["high"]) << 20) + int(r["low"]) for r in parts.agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    return Centre(different.count(), [sums[i] for i in range(size)])


def _reduced(blocks: Iterator[np.ndarray], size: int) -> np.ndarray:
    """Triangular factor of all blocks' rows."""
    factor = np.zeros((0, size))
    for rows in blocks:
        for at in range(0, len(rows), BLOCK):
            factor = np.linalg.qr(np.vstack([factor, rows[at : at + BLOCK]]), "r")
    return np.vstack([factor, np.zeros((size - len(factor), size))])


def triangular(different: DataFrame, size: int, mean: Centre) -> np.ndarray:
    """R of the QR decomposition of all centred vectors."""

    def of_task(frames: Iterator[pa.RecordBatch]) -> bytes:
        return _reduced((mean.around(_matrix(b.column(0), size)) for b in frames), size).tobytes()

    def of_few(factors: list[bytes]) -> bytes:
        return _reduced((np.frombuffer(f).reshape(size, size) for f in factors), size).tobytes()

    return np.frombuffer(of_tasks(different.select("x"), of_task, of_few)).reshape(size, size)


def covariance(different: DataFrame, size: int, mean: Centre, directions: np.ndarray) -> np.ndarray:
    """Covariance of the projected vectors, divisor n, centred by their own mean."""
    k = directions.shape[1]

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in frames:
            w = mean.around(_matrix(batch.column(0), size)) @ directions
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        cells = pa.array(np.arange(total.size, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], ["at", "v"])

    cells = different.select("x").mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1) * k)
    for row in cells.collect():
        total[row["at"]] = row["v"]
    total = total.reshape(k + 1, k) / mean.n
    return total[:k] - np.outer(total[k], total[k])


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding) that takes part and per component, see RESULT."""
    spark = vectors.sparkSession
    rows, size = _filled(whole_numbers(vectors))
    different = written(rows.select("x").distinct(), "different")
    if not size or different.isEmpty():
        return spark.createDataFrame([], RESULT)
    mean = centre(different, size)
    squares, axes = right_singular(triangular(different, size, mean), components)
    if not axes.shape[1]:
        return spark.createDataFrame([], RESULT)
    k = axes.shape[1]
    directions = axes / np.sqrt(squares[:k] / mean.n)
    error = float(np.abs(covariance(different, size, mean, directions) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e)) for e in squares[:k] / squares.sum()])

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), size)
            exact = mean.deviation(x)
            if max(exact) < 1 << 63:
                exact = pa.array(exact, pa.int64()).cast(pa.decimal128(19, 0)).cast(pa.decimal128(38, 0))
            else:
                exact = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            values = pa.array((mean.around(x) @ directions).ravel())
            bounds = pa.array(np.arange(0, values.__len__() + 1, k, dtype=np.int32))
            columns = [batch.column(0), exact, pa.ListArray.from_arrays(bounds, values)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "w"])

    found = small_batches(rows).mapInArrow(work, "vec_id long, deviation decimal(38,0), w array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(mean.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
