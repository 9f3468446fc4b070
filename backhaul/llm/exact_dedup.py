"""Exact duplicates: group by a 128-bit hash, compare bytes inside groups.

Only DataFrame functions. Hashes are counted first (one narrow row per task and hash
is shuffled, however hot a hash is). Only rows whose hash occurs twice have their
text compared: they are grouped by hash *and* text, again combined before the shuffle,
so a collision splits into its different texts. Verdicts go back to the rows by a join
on the hash, which AQE splits where one text holds a large part of all rows.

Defined cases: a null text equals the empty text. Of equal texts the row with the
largest id stays (a null id is smaller than any). Repeated rows (same id, same text)
are one document: each counts in ``group_size`` and all get the same verdict. An empty
table gives an empty result. Other columns are untouched and may have any name. With a row
key, verdicts are for single rows: of equal texts exactly one row is kept, of equal ids
that with the largest key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_order, table, written


def md5_bits(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    carry: list[str] | None = None,
    content_hash: Callable[[Column], Column] = md5_bits,
    key: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``carry`` names columns of ``docs`` that come along, in a struct ``row``; ``key`` one with
    a different long in every row, which comes along as ``key``.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    more = [F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []
    order = [row_order(docs["doc_id"], docs[key], -(2**63) - 1).alias("order")] if key else []
    more += [docs[key].alias("key"), *order] if key else []
    rows = docs.select("doc_id", content_hash(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"), *more)
    bodies = docs.select("doc_id", content_hash(text).alias("fp"), text.alias("body"), *order)
    top = [F.max("order").alias("top")] if key else []

    repeated = bodies.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    repeated = written(repeated, "repeated")
    variants = (
        bodies.join(repeated, "fp", "left_semi")
        .groupBy("fp", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), *top)
    )
    variants = written(variants, "variants")
    per_hash = variants.groupBy("fp").agg(
        F.count("*").alias("texts"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        *([F.max("top").alias("top")] if key else []),
    )
    per_hash = written(per_hash, "verdicts")
    same = rows.join(per_hash, "fp", "left").where("texts IS NULL OR texts = 1")
    names = ["doc_id", "keep_id", "group_size", "text_sha256", *(["row"] if carry else [])]
    names += ["key", "order", "top"] if key else []
    found = same.withColumn(
        "keep_id", F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    ).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    found = found.select(*names)

    collided = per_hash.where("texts > 1").select("fp")
    if not collided.isEmpty():  # different texts under one hash: their rows are told apart by text
        apart = variants.join(collided, "fp", "left_semi")
        again = docs.select(
            "doc_id", content_hash(text).alias("fp"), text.alias("body"), F.sha2(text, 256).alias("text_sha256"), *more
        )
        found = found.unionByName(again.join(apart, ["fp", "body"]).select(*names))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if key:
        kept = F.col("order") == F.coalesce("top", "order")
    last = [n for n in names[3:] if n not in ("order", "top")]
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), *last)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
