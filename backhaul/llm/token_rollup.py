"""Token counts kept up to date by signed changes.

Changes come in numbered batches: inserts, revised counts and deletes of single
documents. A batch becomes signed rows (what a document counted so far is taken back,
what it counts now is added), those are summed per source, language and tokenizer, and
the sums of all batches are the totals. Signed rows are kept by buckets of a document's hash: of what
was counted before, only the buckets that a batch touches are read, so a small batch
reads a small part. ``compact`` puts all signed rows, and all sums, into one place each.

A batch counts from the moment its sums have their ``_SUCCESS`` marker, which Spark's
committer leaves last. A batch that is committed already is left alone if it is the same, and is an
error if it is another one under that number; one that died half-way is written anew. So
sending batches again changes nothing. Batches are applied one after the other.

Defined cases: a document is told by doc_id and, if changes have that column, by ``row``, which keeps
documents apart that share an id or have none. One document and tokenizer has one change per batch; of several, a put
wins over a delete and the larger count over the smaller, so repeated rows count once.
Deleting or revising what is not there is nothing, or an insert. A put of what is there
replaces it. Null ids, sources and languages are values of their own. Empty batches are
committed and add nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root
from ..sources.files import exists, list_files
from .byte_bpe import byte_bpe
from .common import small_batches, table, with_row_key, written

KEYS = ["source", "lang", "tokenizer"]
DOCUMENT = ["doc_id", "row"]
BUCKETS = 64
LEDGER = "doc_id long, row long, tokenizer string, source string, lang string, documents long, tokens long, bucket int"
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, carry: list[str]) -> DataFrame:
    """``carry`` columns and n_tokens of every row's whole text; a null text has none."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        for batch in frames:
            counts = encoder.count([t or "" for t in batch.column(0).to_pylist()])
            columns = [*batch.columns[1:], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "n_tokens"])

    rows = docs.select("text", *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return small_batches(rows).mapInArrow(work, f"{schema}, n_tokens long")


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _complete(self, prefix: str) -> list[int]:
        names = [n for n in list_files(self.spark, f"{self.root}/sums") if n.startswith(prefix)]
        return sorted(int(n[len(prefix) :]) for n in names if exists(self.spark, f"{self.root}/sums/{n}/_SUCCESS"))

    def committed(self) -> list[int]:
        return self._complete("batch-")

    def _read(self, what: str, schema: str) -> DataFrame:
        base = max(self._complete("upto-"), default=0)
        folders = [f"batch-{n:09d}" for n in self.committed() if n > base]
        folders = [f"upto-{base:09d}", *folders] if base else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{what}/{name}") for name in folders]
        return reduce(DataFrame.unionByName, parts)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch of (doc_id, tokenizer, op, source, lang, n_tokens) and maybe row; False if it was already.

        ``op`` is insert, revise or delete; a delete needs no more than doc_id, row and tokenizer.
        """
        if "row" not in changes.columns:
            changes = changes.withColumn("row", F.lit(None).cast("long"))
        columns = [*DOCUMENT, "tokenizer", "op", "source", "lang", "n_tokens"]
        if batch in self.committed():
            if self._digest(changes.select(columns)) != self._known_digest(batch):
                raise ValueError(f"batch {batch} was committed with other changes")
            return False
        latest = changes.groupBy(*DOCUMENT, "tokenizer").agg(
            F.max(F.struct((F.col("op") != "delete").alias("here"), "n_tokens", "source", "lang")).alias("put")
        )
        latest = written(latest.withColumn("bucket", F.pmod(F.xxhash64(*DOCUMENT), F.lit(BUCKETS)).cast("int")), "changes")
        buckets = [r[0] for r in latest.select("bucket").distinct().collect()]  # BUCKETS at most
        ledger = self._read("ledger", LEDGER).where(F.col("bucket").isin(buckets))
        same = [latest[k].eqNullSafe(ledger[k]) for k in (*DOCUMENT, "tokenizer")]
        touched = ledger.join(latest, reduce(and_, same), "left_semi")
        back = touched.groupBy(*DOCUMENT, "tokenizer", "source", "lang", "bucket").agg(
            (-F.sum("documents")).alias("documents"), (-F.sum("tokens")).alias("tokens")
        )
        added = latest.where("put.here").select(
            *DOCUMENT, "tokenizer", "put.source", "put.lang", "bucket", F.lit(1).cast("long").alias("documents"),
            F.coalesce("put.n_tokens", F.lit(0)).cast("long").alias("tokens"),
        )
        signed = back.where("documents <> 0").unionByName(added)
        self._write(signed, f"batch-{batch:09d}")
        digest = self.spark.createDataFrame([(self._digest(changes.select(columns)),)], "digest string")
        digest.write.mode("overwrite").json(f"{self.root}/digests/batch-{batch:09d}")
        sums = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/batch-{batch:09d}").groupBy(*KEYS)
        sums = sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/sums/batch-{batch:09d}")
        return True

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/ledger/{name}")

    def _digest(self, changes: DataFrame) -> str:
        """Of the changes as a set with repetitions."""
        row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in changes.columns])
        sums = changes.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h"))
        return "|".join(map(str, sums.first()))

    def _known_digest(self, batch: int) -> str:
        return self.spark.read.schema("digest string").json(f"{self.root}/digests/batch-{batch:09d}").first()[0]

    def compact(self) -> None:
        """What all batches committed so far add up to, in one place; later batches read that."""
        done = self.committed()
        if not done:
            return
        rows = self._read("ledger", LEDGER).groupBy(*DOCUMENT, "tokenizer", "source", "lang", "bucket")
        rows = rows.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")
        self._write(rows, f"upto-{done[-1]:09d}")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/sums/upto-{done[-1]:09d}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) of what is there now."""
        sums = self._read("sums", TOTALS).groupBy(*KEYS)
        return sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches: all documents counted; those not in English moved to the
    multilingual tokenizer (a delete and an insert each); counts of English documents revised, whose
    line breaks are spaces now; copies of a text deleted, the smallest id
    stays; and the first batch sent again."""
    docs, key = with_row_key(table(spark, sf_dir, "documents"))
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    one, multi = public_tokenizers.path(f"{first}.json"), public_tokenizers.path(f"{second}.tiktoken")
    text = F.coalesce("text", F.lit(""))
    doc = F.struct("doc_id", F.col(key).alias("row"), "source", "lang", F.md5(text).alias("hash")).alias("doc")

    def counted(rows: DataFrame, tokenizer: str) -> DataFrame:
        return written(count_tokens(rows.select("text", doc), tokenizer, ["doc"]).select("doc.*", "n_tokens"), "counted")

    def changes(rows: DataFrame, op: str, *names: str) -> DataFrame:
        tokenizer = F.explode(F.array(*[F.lit(n) for n in names])).alias("tokenizer")
        return rows.select(*DOCUMENT, tokenizer, F.lit(op).alias("op"), "source", "lang", "n_tokens")

    whole = counted(docs, one)
    foreign = counted(docs.where("lang IS NULL OR lang <> 'en'"), multi)
    broken = docs.where("lang = 'en'").where(F.contains("text", F.lit("\n")))
    revised = counted(broken.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))), one)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    keep = written(whole.groupBy("hash").agg(F.min(order).alias("keep")), "keep")
    copies = whole.join(keep, "hash").where(F.col("keep.row") != F.col("row"))
    rollup = TokenRollup(spark, f"{scratch_root(spark)}/rollup-{uuid.uuid4().hex}")
    inserts = changes(whole, "insert", first)
    rollup.apply(1, inserts)
    rollup.apply(2, changes(foreign, "delete", first).union(changes(foreign, "insert", second)))
    rollup.apply(3, changes(revised, "revise", first))
    rollup.compact()
    rollup.apply(4, changes(copies, "delete", first, second))
    rollup.apply(1, inserts)
    return rollup.totals()
