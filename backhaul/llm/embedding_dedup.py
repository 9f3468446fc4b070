"""Embedding near-duplicates by tiled comparison in the order of principal components.

Vectors are turned onto the principal axes of all vectors (a rotation, so products stay
the same) and dealt into tiles of ``TILE`` along the first axis. A product is the part
over the leading dimensions plus a rest, and the rest is at most the product of the
norms of both suffixes. For two tiles the leading parts and bounds of all pairs are one
matrix product (each suffix norm is one more coordinate); only pairs whose bound reaches
the threshold go on to more dimensions, and those left are decided by the cosine of the
original vectors in double precision. Tile pairs whose ranges along the first axes keep
every product below the threshold are not compared at all.

Equal vectors are one class beforehand, with a size, so a vector that many rows share
costs nothing. A pair of tiles returns, per class, how many vectors it found links to,
and the edges of a spanning forest of those links: never the pairs themselves, so a
large group of near copies stays linear in its size.

The comparison is exact and takes all vectors: its work grows with the square of the
number of classes, as every exact method's does on vectors without structure.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components
links with nothing and is its own component. Shorter vectors are filled up with zeros. A
vector without an id is compared like any other and counts among the links of others; a
component is named by the smallest id in it, and by null if it has none (then all of it is
kept). Repeated rows are vectors of their own; rows that share an id belong to one component.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, small_batches, table, with_row_key, written

THRESHOLD = 0.95
TILE = 4096
STRIP = 1024
STEPS = (0.25, 0.5)  # shares of the dimensions after which pairs are given up
RANGES = 4  # axes along which tiles know their extent
SLACK = 1e-4  # single precision of the bounds


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def second_moments(classes: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of all unit vectors: size x size numbers come to the driver."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in frames:
            vectors = unit(_matrix(batch.column(0), size)) if batch.num_rows else np.zeros((0, size))
            total += vectors.T @ vectors
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["at", "v"])

    sums = classes.select("vector").mapInArrow(work, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    found = np.zeros(size * size)
    for row in sums.collect():
        found[row["at"]] = row["v"]
    return found.reshape(size, size)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def tiles(classes: DataFrame, axes: np.ndarray, tile: int) -> DataFrame:
    """Classes along the first axis, in tiles: (tile, nodes, sizes, vectors, low, high).

    Classes are dealt into ranges of the axis and written in order; the numbers of rows
    per range, one per task, give every class its position, and ``tile`` positions at a
    time are a tile.
    """
    size = len(axes)
    first = F.aggregate(
        F.zip_with("vector", F.array(*[F.lit(float(x)) for x in axes[:, 0]]), lambda v, a: F.coalesce(v, F.lit(0.0)) * F.coalesce(a, F.lit(0.0))),
        F.lit(0.0),
        lambda total, x: total + x,
    ) / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, v: total + v * v))
    dealt = classes.withColumn("along", first).repartitionByRange("along").sortWithinPartitions("along", "node")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = written(dealt.select("node", "size", "vector", F.spark_partition_id().alias("range"), row.alias("row")), "ranges")
    begin, begins = 0, []
    for part in sorted(dealt.groupBy("range").count().collect()):
        begins.append((part["range"], begin))
        begin += part["count"]
    starts = classes.sparkSession.createDataFrame(begins, "range int, begin long")
    placed = dealt.join(F.broadcast(starts), "range")  # a row per task
    placed = placed.select(F.expr(f"(begin + row) div {tile}").alias("tile"), "node", "size", "vector")

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        nodes, sizes, vectors = (rows.column(c).chunk(0) for c in ("node", "size", "vector"))
        matrix = _matrix(vectors, size)
        turned = unit(matrix) @ axes[:, :RANGES]
        data = [x.to_numpy().tobytes() for x in (nodes, sizes)]
        values = [rows.column("tile")[0].as_py(), *data, matrix.tobytes(), turned.min(axis=0).tolist(), turned.max(axis=0).tolist()]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        names = ["tile", "nodes", "sizes", "vectors", "low", "high"]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, values, kinds)})

    schema = "tile long, nodes binary, sizes binary, vectors binary, low array<double>, high array<double>"
    return placed.groupBy("tile").applyInArrow(work, schema)  # groups of ``tile`` rows


def tile_pairs(index: DataFrame, last: int, threshold: float) -> DataFrame:
    """(i, j) of tiles, i <= j <= last, that can hold a pair of the threshold. ``index`` has a narrow row per tile."""
    left = index.select(F.col("tile").alias("i"), "low", "high", F.explode(F.sequence("tile", F.lit(last).cast("long"))).alias("j"))
    right = index.select(F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    # Unit vectors with cosine t are sqrt(2 - 2 t) apart; boxes further apart hold no such pair
    gaps = F.zip_with("low", "high_j", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    back = F.zip_with("low_j", "high", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(gaps, back, lambda a, b: a * a + b * b), F.lit(0.0), lambda total, x: total + x)
    return left.join(right, "j").where(apart <= 2 - 2 * threshold + SLACK).select("i", "j")


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (unit vectors) whose cosine reaches the threshold."""
    size = len(axes)
    steps = sorted({max(1, int(size * share)) for share in STEPS})
    ta, tb = a @ axes, b @ axes

    def bounded(turned: np.ndarray, k: int) -> np.ndarray:
        rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", turned[:, k:], turned[:, k:]), 0))
        return np.hstack([turned[:, :k], rest[:, None]])

    k = steps[0]
    lead_a, lead_b = bounded(ta, k).astype(np.float32), bounded(tb, k).astype(np.float32)
    found = []
    for at in range(0, len(a), STRIP):
        x, y = np.nonzero(lead_a[at : at + STRIP] @ lead_b.T >= threshold - SLACK)
        x += at
        for more in steps[1:]:
            wide_a, wide_b = bounded(ta, more), bounded(tb, more)
            keep = _products(wide_a, wide_b, x, y) >= threshold - SLACK
            x, y = x[keep], y[keep]
        keep = _products(a, b, x, y) >= threshold
        found.append((x[keep], y[keep]))
    xs, ys = zip(*found) if found else ((np.zeros(0, int),), (np.zeros(0, int),))
    return np.concatenate(xs), np.concatenate(ys)


def _products(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for at in range(0, len(x), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", a[x[s]], b[y[s]])
    return out


def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with these edges."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    kept = []
    for a, b in zip(x.tolist(), y.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def links(pairs: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """Rows (a, b, null): an edge; (a, null, n): a class's number of linked vectors in one pair of tiles."""
    size = len(axes)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for row in range(batch.num_rows):
                i, j, *data = (batch.column(c)[row].as_py() for c in range(8))
                ni, nj = (np.frombuffer(d, np.int64) for d in data[0:2])
                si, sj = (np.frombuffer(d, np.int64) for d in data[2:4])
                a, b = (unit(np.frombuffer(d, np.float64).reshape(-1, size)) for d in data[4:6])
                x, y = compare_tiles(a, b, axes, threshold)
                if i == j:
                    x, y = x[x < y], y[x < y]
                edges = forest(ni[x], nj[y])
                nodes = np.concatenate([ni[x], nj[y]])
                counts = np.concatenate([sj[y], si[x]])
                own, at = np.unique(nodes, return_inverse=True)
                total = np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)
                first = [e[0] for e in edges] + own.tolist()
                second = [e[1] for e in edges] + [None] * len(own)
                number = [None] * len(edges) + total.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (first, second, number)], ["a", "b", "n"])

    return small_batches(pairs).mapInArrow(work, "a long, b long, n long")


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    top = F.array_max(F.transform("vector", F.abs))
    whole = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.coalesce(whole & (top > 0), F.lit(False))
    good = rows.where(valid)
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    keyed, key = with_row_key(written(classes.select("least", "size", "vector"), "classes"))
    classes = keyed.withColumnRenamed(key, "node")  # ids may be missing or repeat, so nodes have numbers of their own
    n, size = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))
    values, axes = np.linalg.eigh(second_moments(classes, size))
    axes = np.ascontiguousarray(axes[:, ::-1])
    stored = written(tiles(classes.select("node", "size", "vector"), axes, tile), "tiles")
    pairs = tile_pairs(stored.select("tile", "low", "high"), (n - 1) // tile, threshold)
    parts = [
        stored.select(F.col("tile").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("nodes", "sizes", "vectors")])
        for k in "ij"
    ]
    both = pairs.join(parts[0], "i").join(parts[1], "j")
    both = both.select("i", "j", "nodes_i", "nodes_j", "sizes_i", "sizes_j", "vectors_i", "vectors_j")
    found = written(links(both, axes, threshold), "links")
    degree = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    # Classes of one id belong together; few ids have more than one vector
    owned = good.join(classes.select("node", "vector"), "vector").where("vec_id IS NOT NULL").select("vec_id", "node").distinct()
    by_id = owned.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same = owned.join(by_id.select("vec_id", "a"), "vec_id").where("node <> a").select("a", F.col("node").alias("b"))
    edges = found.where("b IS NOT NULL").select("a", "b").unionByName(same)
    components = connected_components(edges)
    placed = classes.select("node", "least", "size").join(degree, classes["node"] == degree["a"], "left")
    placed = placed.join(components.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    placed = written(
        placed.select(
            "node", "least", F.coalesce("component", "node").alias("component"),
            (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        ),
        "placed",
    )
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "component").select("node", "n_links", "component_id")
    named = named.join(classes.select("node", "vector"), "node").drop("node")
    out = good.join(written(named, "named"), "vector").select("vec_id", "n_links", "component_id")
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
