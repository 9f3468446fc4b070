"""From ``documents`` to training sequences: four stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns
of ``documents``. Null and blank texts have no language and go in the first stage, which also
names the language of documents that come without one. Verdicts
are for rows: of equal texts, and of near copies, exactly one row stays, whether or not rows
share an id or have none. The last stage gives the sequences' pieces with their token ids.
Empty input gives empty output; further columns come along, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.llm.common import forget, with_row_key, written
from backhaul.llm.exact_dedup import exact_duplicates
from backhaul.llm.language import UNKNOWN, identify
from backhaul.llm.packing import pack
from backhaul.llm.simhash import simhash_groups
from backhaul.session import scratch_root


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, also if there is nothing to learn languages from; where ``lang`` is null,
    with the predicted one."""
    found = identify(docs, carry=docs.columns).where("has_letter")
    lang = F.coalesce("row.lang", F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))).alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return _kept(docs, exact_duplicates)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by their fingerprints, the one with the smallest id stays."""
    return _kept(docs, simhash_groups)


def _kept(docs: DataFrame, judge: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``docs`` that are kept. The keys of the others are written first: Spark then
    knows the list's size, and moves no text where it is small enough to broadcast."""
    keyed, key = with_row_key(docs)
    gone = written(judge(keyed, key=key).where("NOT kept").select(F.col("key").alias(key)), "gone")
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in sequences of equal length and balanced cost."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language ID", with_language),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL has neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage wrote goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{scratch_root(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            forget(docs)
        docs = spark.read.parquet(path)
    return docs
