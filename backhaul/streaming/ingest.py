"""Incremental ingest: files that arrive in a folder, each loaded once.

The stream keeps no state of its own. A row is new if its hash is not in the table,
for all time, so there is nothing a watermark could expire: each micro-batch is
compared with the table. Its rows and its log entry are published in one version of the
tables, and the entry names the batch: a failure leaves both or neither, and a batch that is
replayed after it was published is left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.load import Tables, insert_new, load_sheet, numbered
from ..sources.log import append_upload
from ..sources.records import BREAK, has_breaks, parsed, with_rows, with_splits, without_header
from ..sources.sheets import Sheet, header_names, placed, positional_schema, sheet_of_records
from ..sources.staging import staged
from ..sources.tables import SnapshotTable


def stream_ingest(
    spark: SparkSession,
    folder: str,
    headers: Sequence[str],
    tables: Tables,
    checkpoint: str,
    kind: str | None = None,
    sep: str = ",",
    multiline: bool | None = None,
    max_files_per_trigger: int | None = None,
    uploaded_by: str = "Team Member",
) -> StreamingQuery:
    """Load every file of ``folder`` not loaded before, then stop.

    All files share ``headers``. Quoted cells may hold line breaks: every micro-batch finds out,
    from its lines, and records of several lines are put together by tasks that share large
    files. ``multiline=False`` saves that. Returns the started query; call ``awaitTermination`` on it.
    """
    reader = spark.readStream.option("lineSep", BREAK)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    shape = positional_schema(headers)

    def load(batch: DataFrame, batch_id: int) -> None:
        name = f"{checkpoint}#{batch_id}"
        digest = hashlib.md5(name.encode()).hexdigest()
        lines = with_rows(batch)

        def work() -> None:
            if not tables.log.read().filter(F.col("file_hash") == digest).isEmpty():
                return  # a replay of what was published
            if multiline is not False and has_breaks(lines, sep):
                sheet = sheet_of_records(lines, headers, sep)
            else:
                sheet = Sheet(placed(parsed(without_header(lines), shape, sep)), header_names(headers))
            counts = load_sheet(tables, sheet, kind)
            append_upload(
                tables.log, name.rsplit("/", 1)[-1], digest, kind or "auto", counts["added"], counts["skipped"], uploaded_by
            )

        tables.commits.atomically(work)

    return _start(with_splits(reader.text(folder)), load, checkpoint)


def stream_rows(
    rows: DataFrame, table: SnapshotTable, checkpoint: str, order_by: str = "id"
) -> StreamingQuery:
    """Load a stream of canonical rows (with row_hash and an ordering column)."""

    def load(batch: DataFrame, batch_id: int) -> None:
        with staged(numbered(batch, order_by)) as arrived:
            insert_new(table, arrived)

    return _start(rows, load, checkpoint)


def _start(
    rows: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
