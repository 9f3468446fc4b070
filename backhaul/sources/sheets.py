"""Raw sheets: delimited text (or typed Parquet) with inconsistent headers.

Headers such as ``Reason`` and ``reason`` may stand side by side, which Spark's
case-insensitive resolution cannot address by name. A ``Sheet`` therefore renames
the columns by position and keeps the exact header text in a driver-side map.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import js_number_text
from ..functions.text import BLANKS
from ..schema import SEQ
from .records import has_breaks, parsed, read_lines, records
from .staging import forget

ZERO = r"^-?0+(?:\.0*)?$"
TAB_SUFFIXES = (".tsv", ".txt", ".tab")


def _zero(text: Column) -> Column:
    """Whether a text is a zero. Only those that begin with one or a sign are searched."""
    return (text >= "-") & (text < "1") & text.rlike(ZERO)


def arrival_order() -> Column:
    """File order of rows, to be selected directly on top of a file scan.

    One split of a file is read front to back by one task, so within
    (file, split start) the increasing id is the row position. Rows keep their
    place when a task is run again, because the file is read the same way.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


@dataclass(frozen=True)
class Sheet:
    """Rows of one sheet: positional columns plus exact header -> column name.

    ``parts`` is a written list that the rows are read with; ``release`` deletes it.
    """

    rows: DataFrame
    headers: Mapping[str, str]
    parts: DataFrame | None = None

    def release(self) -> None:
        """To be called when the rows are not read any more."""
        if self.parts is not None:
            forget(self.parts)

    @classmethod
    def of(cls, df: DataFrame, keep: Sequence[str] = ("id", SEQ)) -> Sheet:
        """Wrap a DataFrame whose column names are raw headers.

        Headers are trimmed; of two equal ones the later wins. Columns named in
        ``keep`` are carried along unchanged (row ids, arrival order).
        """
        names, headers = [], {}
        for position, raw in enumerate(df.columns):
            if raw in keep:
                names.append(raw)
                continue
            name = f"_c{position}"
            names.append(name)
            headers[raw.strip(BLANKS)] = name
        return cls(df.toDF(*names), headers)

    @property
    def carried(self) -> list[str]:
        cells = set(self.headers.values())
        return [c for c in self.rows.columns if c not in cells]

    def cell(self, header: str) -> Column | None:
        """Text of a cell, or None if the sheet has no such header.

        Typed columns (a Parquet export) become the text a sheet would show. A
        typed zero is an empty cell, as zeros are falsy to the alias rule.
        """
        name = self.headers.get(header)
        if name is None:
            return None
        kind = self.rows.schema[name].dataType
        column = F.col(name)
        if isinstance(kind, T.NumericType):
            return F.when(column != 0, js_number_text(column))
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, "yyyy-MM-dd")
        return column.cast("string")

    def cells(self, aliases: Iterable[str]) -> list[Column]:
        return [c for c in map(self.cell, aliases) if c is not None]

    def raw(self, aliases: Iterable[str], zero_is_missing: bool = False) -> Column:
        """First filled cell of the aliases, untrimmed; ``''`` if none."""
        filled = [F.nullif(c, F.lit("")) for c in self.cells(aliases)]
        if zero_is_missing:
            filled = [F.when(~_zero(c), c) for c in filled]
        return F.coalesce(*filled, F.lit(""))


def trim_headers(df: DataFrame) -> DataFrame:
    """Trimmed headers and no NULL cells, for sheets without colliding headers."""
    names = [c.strip(BLANKS) for c in df.columns]
    return df.toDF(*names).na.fill("")


def separator_for(path: str) -> str:
    return "\t" if path.lower().rstrip("/").endswith(TAB_SUFFIXES) else ","


def breaks_in_quotes(spark: SparkSession, paths: str | Sequence[str], sep: str) -> bool:
    """Whether a quote is open at the end of any line: one pass in which tasks share large files."""
    return has_breaks(read_lines(spark, paths), sep)


def read_headers(
    spark: SparkSession, path: str, sep: str | None = None, multiline: bool = True
) -> list[str]:
    """Header line of a delimited sheet (one row on the driver)."""
    reader = _csv(spark.read, sep or separator_for(path)).option("multiLine", multiline)
    first = reader.option("header", False).csv(path).first()
    return [] if first is None else [v or "" for v in first]


def read_sheet(
    spark: SparkSession,
    path: str,
    headers: Sequence[str] | None = None,
    sep: str | None = None,
    multiline: bool | None = None,
) -> Sheet:
    """Read one delimited sheet (a file, or a folder of parts with equal headers).

    Everything is text, nothing is inferred. Quoted cells may hold line breaks; large files are
    split between tasks with and without them (``records``). ``multiline`` tells whether there
    are any and saves finding out: False reads lines as records, True has each file
    read by one task of Spark's own reader.
    """
    sep = sep or separator_for(path)
    headers = list(headers) if headers is not None else read_headers(spark, path, sep, multiline is not False)
    shape = positional_schema(headers)
    if multiline is None:
        lines = read_lines(spark, path)
        if has_breaks(lines, sep):
            return sheet_of_records(lines, headers, sep)
    reader = _csv(spark.read, sep).option("header", True).option("multiLine", bool(multiline))
    return sheet_from_positions(reader.schema(shape).csv(path), headers)


def sheet_of_records(lines: DataFrame, headers: Sequence[str], sep: str) -> Sheet:
    """The sheet of ``read_lines``, records of several lines put together."""
    found = records(lines, sep)
    return Sheet(placed(parsed(found.rows, positional_schema(headers), sep)), header_names(headers), found.parts)


def placed(rows: DataFrame) -> DataFrame:
    """Parsed records with their arrival order."""
    return rows.withColumn(SEQ, F.struct("file", "start", "row")).drop("file", "start", "row")


def positional_schema(headers: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(headers))])


def header_names(headers: Sequence[str]) -> dict[str, str]:
    """Exact (trimmed) header -> positional column; of two equal headers the later wins."""
    return {h.strip(BLANKS): f"_c{i}" for i, h in enumerate(headers)}


def sheet_from_positions(rows: DataFrame, headers: Sequence[str]) -> Sheet:
    """Attach header text and arrival order to a freshly scanned sheet."""
    return Sheet(rows.select("*", arrival_order().alias(SEQ)), header_names(headers))


def read_typed_sheet(spark: SparkSession, path: str) -> Sheet:
    """Read a sheet exported as Parquet, with numbers and dates as such.

    Headers must not differ in case only; delimited text has no such limit.
    """
    return Sheet.of(spark.read.parquet(path).select("*", arrival_order().alias(SEQ)))


def _csv(reader, sep: str):
    return reader.option("sep", sep).option("quote", '"').option("escape", '"')


def detect_kind(headers: Iterable[str]) -> str:
    """``returns`` if any header is one of the returns markers, else ``orders``."""
    lowered = {h.strip(BLANKS).lower() for h in headers}
    return "returns" if lowered & schema.RETURNS_MARKER_HEADERS else "orders"


def route(sheet_names: Sequence[str], kind: str = "auto") -> dict[str, str]:
    """Which sheet feeds which table: ``{'orders': sheet, 'returns': sheet}``.

    Named raw sheets always load. A kind asked for takes the first sheet when its
    own is missing, except that returns never fall back to a sheet already taken
    as orders. With neither, the first sheet is ``auto``: its headers decide.
    """
    plan: dict[str, str] = {}
    if not sheet_names:
        return plan
    first = sheet_names[0]
    if schema.ORDERS_SHEET in sheet_names:
        plan["orders"] = schema.ORDERS_SHEET
    elif kind == "orders":
        plan["orders"] = first
    if schema.RETURNS_SHEET in sheet_names:
        plan["returns"] = schema.RETURNS_SHEET
    elif kind == "returns" and "orders" not in plan:
        plan["returns"] = first
    return plan or {"auto": first}


def read_workbook(
    spark: SparkSession, sheets: Mapping[str, str], kind: str = "auto", **options
) -> dict[str, Sheet]:
    """Read the sheets of one workbook, exported one delimited file per sheet.

    ``sheets`` maps sheet name to path, in workbook order. The result maps
    ``orders`` / ``returns`` to the sheet to load.
    """
    loaded: dict[str, Sheet] = {}
    for target, name in route(list(sheets), kind).items():
        sheet = read_sheet(spark, sheets[name], **options)
        loaded[detect_kind(sheet.headers) if target == "auto" else target] = sheet
    return loaded
