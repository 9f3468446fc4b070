"""Returns import: insert new records, fill blank dispositions of known ones.

All that matters per hash of a batch is where its first row and its first filled row
stand, what that fills in, and whether the table has the hash and still blank. That
state aggregates before the shuffle, and one state serves counts, inserts and fills:
functions here take it as ``state``. A loader writes it first (``plans.load``), so that
joining rows with it is a join of two scans, which AQE splits where a hash is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_blank, non_blank
from ..schema import SEQ
from .keep import insert_ignore, stored_matches

ADDED, UPDATED, SKIPPED = "added", "updated", "skipped"
NUMBER = "row"  # of an arrival order made unique: the part that is a number


def hash_state(stored: DataFrame, batch: DataFrame, order_by: str = SEQ) -> DataFrame:
    """(row_hash, n, first_at, filled_at, fill, stored_blank) of the batch's hashes.

    ``stored_blank`` is NULL for hashes the table does not have.
    """
    rows = batch.select("row_hash", order_by, "disposition").filter(F.col("row_hash").isNotNull())
    filled = F.when(non_blank("disposition"), F.struct(F.col(order_by).alias("at"), "disposition"))
    per_hash = rows.groupBy("row_hash").agg(
        F.count("*").alias("n"), F.min(order_by).alias("first_at"), F.min(filled).alias("filled")
    )
    known = stored_matches(stored, rows, "row_hash", is_blank("disposition").alias("blank"))
    known = known.groupBy("row_hash").agg(F.bool_or("blank").alias("stored_blank"))
    return per_hash.join(known, "row_hash", "left").select(
        "row_hash", "n", "first_at", F.col("filled.at").alias("filled_at"),
        F.col("filled.disposition").alias("fill"), "stored_blank",
    )


def added_rows(
    batch: DataFrame, state: DataFrame, order_by: str = SEQ, lists: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Rows to insert: the first of each hash the table does not have, and those without a
    hash. A first row that is blank takes the first disposition the batch fills in.

    ``lists`` are ``left_out`` and ``late_fills``, written: most of a batch is added, so whole
    rows that meet these two, which are mostly short, are not shuffled.
    """
    columns = batch.columns
    own = F.nullif(F.col("disposition"), F.lit(""))
    filled = F.coalesce(own, "_fill", "disposition")
    if lists is not None:
        out, late = lists
        number = F.col(order_by)[NUMBER]
        kept = batch.join(out.withColumnRenamed("_row", "_out"), number == F.col("_out"), "left_anti")
        kept = kept.join(late.withColumnRenamed("_row", "_late"), number == F.col("_late"), "left")
        return kept.withColumn("disposition", filled).select(*columns)
    fresh = state.filter(F.col("stored_blank").isNull()).select(
        "row_hash", F.col("first_at").alias("_first"), F.col("fill").alias("_fill")
    )
    first = batch.join(fresh, "row_hash").filter(F.col(order_by) == F.col("_first"))
    first = first.withColumn("disposition", filled).select(*columns)
    return first.unionByName(batch.filter(F.col("row_hash").isNull()))


def left_out(batch: DataFrame, state: DataFrame, order_by: str) -> DataFrame:
    """Numbers of the rows that are not inserted. The order ends in a unique number of each row."""
    firsts = state.filter(F.col("stored_blank").isNull()).select(F.col("first_at")[NUMBER].alias("_first"))
    numbers = batch.filter(F.col("row_hash").isNotNull()).select(F.col(order_by)[NUMBER].alias("_row"))
    return numbers.join(firsts, F.col("_row") == F.col("_first"), "left_anti")


def late_fills(state: DataFrame) -> DataFrame:
    """(number of a row to insert, disposition) where a later row of the batch fills it in."""
    late = state.filter(F.col("stored_blank").isNull() & (F.col("filled_at") != F.col("first_at")))
    return late.select(F.col("first_at")[NUMBER].alias("_row"), F.col("fill").alias("_fill"))


def fills(state: DataFrame) -> DataFrame:
    """(row_hash, fill) of the hashes whose stored row is blank and gets a disposition."""
    return state.filter(F.col("stored_blank") & F.col("fill").isNotNull()).select("row_hash", "fill")


def fill_blanks(stored: DataFrame, fill: DataFrame) -> DataFrame:
    """Stored rows with their blanks filled; rows that are not blank pass without a join."""
    open_ = is_blank("disposition") & F.col("row_hash").isNotNull()
    filled = stored.filter(open_).join(fill, "row_hash", "left")
    filled = filled.withColumn("disposition", F.coalesce("fill", "disposition")).select(*stored.columns)
    rest = stored.filter(F.col("row_hash").isNull() | non_blank("disposition"))
    return rest.unionByName(filled)


def upsert_disposition(
    stored: DataFrame, batch: DataFrame, order_by: str = SEQ, state: DataFrame | None = None
) -> DataFrame:
    """The table after the import: blanks filled, new hashes inserted (first row wins)."""
    state = hash_state(stored, batch, order_by) if state is None else state
    added = added_rows(batch, state, order_by).select(*stored.columns)
    return fill_blanks(stored, fills(state)).unionByName(added)


def upsert_actions(
    stored: DataFrame, batch: DataFrame, order_by: str = SEQ, state: DataFrame | None = None
) -> DataFrame:
    """What happens to each row of the batch: (row_hash, order, still_blank, action).

    In arrival order, the first row of an unknown hash is added. Any other row is
    updated if the stored disposition is still blank when it arrives (even if the
    row brings a blank itself), else skipped.
    """
    state = hash_state(stored, batch, order_by) if state is None else state
    narrow = batch.select("row_hash", order_by)
    without_hash = narrow.filter(F.col("row_hash").isNull()).select(
        "row_hash", order_by, F.lit(False).alias("still_blank"), F.lit(ADDED).alias("action")
    )
    decided = narrow.join(state, "row_hash").select("row_hash", order_by, *_decide(F.col(order_by)))
    return decided.unionByName(without_hash)


def upsert_counts(
    stored: DataFrame, batch: DataFrame, order_by: str = SEQ, state: DataFrame | None = None
) -> DataFrame:
    """Counts of a returns import: one row (added, updated, skipped).

    What ``upsert_actions`` counted would give, without deciding row by row. A hash
    is settled by its number of rows if it is filled already, filled by its first row
    or never filled. Rows are looked up only for hashes where blanks come first and
    are filled later within the batch.
    """
    state = hash_state(stored, batch, order_by) if state is None else state
    # Rows up to the first filled one: those find the disposition blank.
    leading = (
        F.when(~F.coalesce("stored_blank", F.lit(True)), F.lit(0))
        .when(F.col("filled_at").isNull(), F.col("n"))
        .when(F.col("filled_at") == F.col("first_at"), F.lit(1))
    )
    state = state.withColumns({"is_new": F.col("stored_blank").isNull().cast("int"), "leading": leading})
    open_ = state.filter(F.col("leading").isNull()).select("row_hash", "filled_at")
    looked_up = batch.select("row_hash", order_by).join(open_, "row_hash")
    looked_up = looked_up.filter(F.col(order_by) <= F.col("filled_at"))
    nothing = F.lit(0)
    parts = [
        # An added row is one of the leading ones, but not updated.
        state.select("n", "is_new", (F.coalesce("leading", nothing) - F.col("is_new")).alias("updated")),
        looked_up.select(nothing.alias("n"), nothing.alias("is_new"), F.lit(1).alias("updated")),
        batch.filter(F.col("row_hash").isNull()).select(
            F.lit(1).alias("n"), F.lit(1).alias("is_new"), nothing.alias("updated")
        ),
    ]
    sums = reduce(DataFrame.unionByName, parts).agg(
        *[F.coalesce(F.sum(c), nothing).cast("bigint").alias(c) for c in ("n", "is_new", "updated")]
    )
    skipped = F.col("n") - F.col("is_new") - F.col("updated")
    return sums.select(F.col("is_new").alias(ADDED), UPDATED, skipped.alias(SKIPPED))


def _decide(at: Column) -> list[Column]:
    stored = F.col("stored_blank").isNotNull()
    is_new = ~stored & (at == F.col("first_at"))
    open_before = F.col("filled_at").isNull() | (at <= F.col("filled_at"))
    # A first row that is inserted closes the gap itself if it is filled: then
    # filled_at equals first_at and every later row lies behind it.
    still_blank = ~is_new & open_before & F.coalesce("stored_blank", F.lit(True))
    action = F.when(is_new, ADDED).when(still_blank, UPDATED).otherwise(SKIPPED)
    return [still_blank.alias("still_blank"), action.alias("action")]


def ingest_actions(stored: DataFrame, batch: DataFrame, order_by: str = SEQ) -> DataFrame:
    """Counts of a first-wins insert: one row (added, skipped)."""
    added = insert_ignore(batch.select("row_hash", order_by), stored, [order_by])
    tagged = added.select(F.lit(1).alias("is_added"), F.lit(0).alias("is_row")).unionAll(
        batch.select(F.lit(0).alias("is_added"), F.lit(1).alias("is_row"))
    )
    total = tagged.agg(F.sum("is_added").alias("added"), F.sum("is_row").alias("seen"))
    return total.select(
        F.coalesce("added", F.lit(0)).alias("added"),
        F.coalesce(F.col("seen") - F.col("added"), F.lit(0)).alias("skipped"),
    )


def action_counts(actions: DataFrame) -> DataFrame:
    """(action, n) of an import."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))
