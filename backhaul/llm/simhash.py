"""SimHash near-duplicates by an inverted index of fingerprint bytes.

A fingerprint has eight bytes. Two that differ in at most ``max_bits`` = 2 bits share at
least six of them, position by position; so of four pairs of neighbouring bytes they
share at least two. The index lists, for each two of the four pairs, the fingerprints
with the same four bytes in those positions (a list per single byte would hold a 256th
of all fingerprints, and its pairs grow with the square of the input). Fingerprints on a
common list are candidates; shared positional bytes are tallied, pairs under six are
dropped, the rest is verified bit by bit.

Only different fingerprints are listed, so copies cost nothing. A list longer than
``long_list`` is not paired: its fingerprints are linked through their neighbours at one
bit. Two fingerprints at most two bits apart have such a neighbour in common (or are one
another's), all fingerprints at one neighbour are at most two bits apart, and there are
65 at most. Linking each to the smallest of them gives the same components with 65 rows
a fingerprint, whatever the length of the list.

Defined cases: a null or blank text has fingerprint zero, which links like any other;
fewer words than a shingle are one shingle. Repeated rows stay. A row with a null doc_id
has the component of its fingerprint; a component without any id has a null one. An empty
table gives an empty result. With a row key, exactly one row of a component is kept: that
of the smallest id, of equal ids that with the smallest key; rows without an id come last.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, row_order, small_batches, table, written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
LONG_LIST = 16
_PART = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; bit k is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # of bytes: folds A-Z, splits at the six ASCII white spaces
    if not words:
        return 0
    whole = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        spans: Iterator = iter([(0, len(whole))])
        n = 1
    else:
        spans = zip([0, *ends], (e - 1 for e in ends[shingle - 1 :]))
        n = len(words) - shingle + 1
    seed, digest = SEED, xxh64_intdigest
    bits = np.zeros(64, np.int64)
    hashes = (digest(whole[a:b], seed) for a, b in spans)
    for at in range(0, n, _PART):  # so that a very long text needs bounded memory
        part = np.fromiter(hashes, "<u8", min(_PART, n - at))
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and its ``key`` if one is named; fp holds the 64 bits as a signed long."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            found = [fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), bits, *batch.columns[2:]], ["doc_id", "fp", *more])

    more = ["key"] if key else []
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *[docs[key].alias("key") for _ in more])
    return small_batches(rows).mapInArrow(work, "doc_id long, fp long" + ", key long" * len(more))


def linked(fps: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``fps`` (column fp) whose components are
    those of all pairs at most ``max_bits`` <= 2 bits apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("lists of four bytes find pairs up to two bits apart")
    pairs_of_bytes = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    keys = [
        F.struct(F.lit(n).alias("which"), pairs_of_bytes[i].alias("x"), pairs_of_bytes[j].alias("y"))
        for n, (i, j) in enumerate(itertools.combinations(range(4), 2))
    ]
    lists = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    lengths = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lengths = written(lengths, "lists")

    short = lists.join(lengths.where(F.col("n") <= long_list), "key", "left_semi")
    short = written(short, "short")
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(
        (F.shiftrightunsigned(differ, 8 * k).bitwiseAND(0xFF) == 0).cast("int") for k in range(8)
    )
    pairs = a.join(b, "key").where("a < b").where(shared >= 8 - max_bits).where(F.bit_count(differ) <= max_bits)

    crowd = lists.join(lengths.where(F.col("n") > long_list), "key", "left_semi").select("fp").distinct()
    if max_bits == 2:  # neighbours at one bit, and itself
        flips = [F.lit(0).cast("long"), *[F.lit(v).cast("long") for v in (1 << np.arange(64, dtype=np.uint64)).view(np.int64).tolist()]]
        near = crowd.select("fp", F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("spot"))
        near = written(near, "spots")
        centre = written(near.groupBy("spot").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "centres")
        stars = near.join(centre, "spot").where("a <> fp").select("a", F.col("fp").alias("b"))
    else:  # at most one bit: one of both is a neighbour of the other
        flips = [F.lit(v).cast("long") for v in (1 << np.arange(64, dtype=np.uint64)).view(np.int64).tolist()] * max_bits
        near = crowd.select(F.col("fp").alias("a"), F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("b")) if flips else crowd.selectExpr("fp a", "fp b")
        stars = near.join(crowd.withColumnRenamed("fp", "b"), "b", "left_semi").select("a", "b")
    return pairs.select("a", "b").union(stars)


def simhash_groups(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, long_list: int = LONG_LIST, key: str | None = None
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    ``key`` names a column with a different long in every row; it adds ``key`` and ``kept``.
    """
    prints = written(fingerprints(docs, shingle, key), "fingerprints")
    order = row_order(F.col("doc_id"), F.col("key"), 2**63) if key else None
    least = [F.min(order).alias("least")] if key else []
    also = ["least"] if key else []
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), *least), "different")
    components = written(connected_components(linked(fps.select("fp"), max_bits, long_list)), "components")
    named = fps.join(components, fps["fp"] == components["node"], "left")
    named = named.select("fp", "first", F.coalesce("component", "fp").alias("component"), *also)
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"), *[F.min(c).alias(c) for c in also])
    named = written(named.drop(*also).join(written(ids, "ids"), "component").select("fp", "component_id", *also), "named")
    out = prints.join(named, "fp")
    verdict = ["key", (order == F.col("least")).alias("kept")] if key else []
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *verdict)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
