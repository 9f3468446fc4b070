"""Keep the best row per key; skip rows whose key is already stored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import non_blank
from ..schema import SEQ

RANK = "_rank"


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column | str],
    nonblank: Sequence[str] = (),
    nonnull: Sequence[str] = (),
) -> DataFrame:
    """The first row per key, plus every row outside the scope.

    Rows with a NULL or empty ``nonblank`` column, or a NULL ``nonnull`` column,
    are outside the scope and kept as they are, without a shuffle. For the rest
    ``row_number() = 1`` lets Catalyst put a group limit before the exchange: each
    task sends at most one row per key, however many rows a key has.
    """
    scope = [non_blank(c) for c in nonblank] + [F.col(c).isNotNull() for c in nonnull]
    inside = df.filter(reduce(and_, scope)) if scope else df
    by_key = Window.partitionBy(*keys).orderBy(*order_by)
    first = inside.withColumn(RANK, F.row_number().over(by_key)).filter(F.col(RANK) == 1).drop(RANK)
    if not scope:
        return first
    # Spelled out, not as NOT(scope): NULLs count as outside, and the scan can
    # take these comparisons as pushed filters.
    beyond = [F.col(c).isNull() | (F.col(c) == "") for c in nonblank]
    beyond += [F.col(c).isNull() for c in nonnull]
    return first.unionByName(df.filter(reduce(or_, beyond)))


def first_by_hash(
    batch: DataFrame,
    order_by: Sequence[Column | str] = (SEQ,),
    key: str = "row_hash",
    left_out: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """The earliest row per hash; rows without a hash never conflict.

    ``left_out`` is the column that numbers the rows and the written list of ``repeated_rows``. It mostly
    is short enough to be sent to the rows, which then stay where they are.
    """
    if left_out is None:
        return keep_first(batch, [key], order_by, nonnull=[key])
    number, rows = left_out
    return batch.join(rows, F.col(number) == F.col("_row"), "left_anti")


def repeated_hashes(batch: DataFrame, key: str = "row_hash") -> DataFrame:
    """Hashes that come more than once: all that ``repeated_rows`` shuffles of the others."""
    return batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)


def repeated_rows(
    batch: DataFrame, again: DataFrame, number: str, order_by: Sequence[Column | str] = (SEQ,), key: str = "row_hash"
) -> DataFrame:
    """Numbers of the rows that are not the earliest of their hash, ``again`` being the repeated hashes."""
    rows = batch.join(again, key, "left_semi")
    firsts = rows.groupBy(key).agg(F.min(F.struct(*order_by, F.col(number).alias("_first")))["_first"].alias("_first"))
    return rows.select(F.col(number).alias("_row")).join(firsts, F.col("_row") == F.col("_first"), "left_anti")


def stored_matches(
    stored: DataFrame, batch: DataFrame, key: str, *columns: Column | str
) -> DataFrame:
    """Key (and ``columns``) of the stored rows whose key occurs in the batch.

    A batch is small next to the table it goes into. While its distinct keys fit
    Spark's broadcast threshold, which Catalyst checks against their size, the stored
    keys are filtered where they are read and nothing of the table is shuffled. A
    batch too large for that makes it a shuffle join on the key column alone.
    """
    wanted = batch.select(key).filter(F.col(key).isNotNull()).distinct()
    return stored.select(key, *columns).join(wanted, key, "left_semi")


def new_by_key(
    batch: DataFrame,
    stored: DataFrame,
    order_by: Sequence[Column | str] = (SEQ,),
    key: str = "row_hash",
    small: bool = True,
) -> DataFrame:
    """First row per key that is not stored yet; rows without a key are left out.

    The anti join reuses the exchange of the ranking, so whole rows are shuffled
    once; of the stored table only the key column is read. Both sides hold a key at
    most once by then, so none is hot. ``small=False`` is for a batch that is not small next to the
    table: the table's keys, each once a task, are met as they are, and the batch's are not dealt again.
    """
    first = keep_first(batch.filter(F.col(key).isNotNull()), [key], order_by)
    known = stored_matches(stored, batch, key) if small else stored.select(key).filter(F.col(key).isNotNull()).distinct()
    return first.join(known, key, "left_anti").select(*batch.columns)


def insert_ignore(
    batch: DataFrame,
    stored: DataFrame,
    order_by: Sequence[Column | str] = (SEQ,),
    key: str = "row_hash",
    small: bool = True,
) -> DataFrame:
    """Rows of the batch to add: first per hash and not stored yet, or without a hash.

    Rows without a hash go around the join; in it they would all meet in one task.
    """
    return new_by_key(batch, stored, order_by, key, small).unionByName(batch.filter(F.col(key).isNull()))
