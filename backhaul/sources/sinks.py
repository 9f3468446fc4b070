"""CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, quote_all: bool = False, single_file: bool = False) -> None:
    """Write a report with headers into folder ``path``.

    ``single_file`` is for reports with one row per month or week. Record exports
    stay distributed: one part per task, in the order of ``df``.
    """
    out = df.coalesce(1) if single_file else df
    writer = out.write.option("header", True).option("quoteAll", quote_all)
    writer.option("escape", '"').option("emptyValue", "").csv(path)
