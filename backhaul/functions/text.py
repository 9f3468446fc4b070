"""Text expressions: blanks, alias chains, display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

# Every character the raw sheets' trimming removes, in code point
# order (control blanks, space, no-break space, Unicode space separators, line and
# paragraph separators, ideographic space, byte order mark).
BLANKS = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _printable_first(text: Column) -> Column:
    """Whether the first character is a printable one of ASCII, and no blank: texts compare by their bytes."""
    return (text >= "!") & (text < "\x7f")


def _printable(char: Column) -> Column:
    """The same of a text of one character, which is mentioned, and so taken, once."""
    return F.abs(F.ascii(char) * 2 - 159) <= 93


def trimmed(value: Column | str) -> Column:
    """Without blanks at either end. Most cells have none, which their first and last
    character tell; only the others pay for the search in the list of blanks."""
    text = as_column(value)
    untouched = _printable_first(text) & _printable(F.right(text, F.lit(1)))
    return F.when(untouched, text).otherwise(F.btrim(text, F.lit(BLANKS)))


def first_nonblank(*cells: Column | str) -> Column:
    """First cell that is not empty, trimmed; ``''`` if all are missing.

    A cell of only blanks counts as filled: emptiness is tested before trimming.
    """
    filled = [F.nullif(as_column(c), F.lit("")) for c in cells]
    return trimmed(F.coalesce(*filled, F.lit("")))


def is_blank(value: Column | str) -> Column:
    """NULL or empty; never NULL itself."""
    return F.coalesce(as_column(value), F.lit("")) == ""


def non_blank(value: Column | str) -> Column:
    """Plain inequality, so a scan can push it down; NULL is dropped by a filter."""
    return as_column(value) != ""


def not_placeholder(value: Column | str) -> Column:
    return ~as_column(value).isin("", schema.BRAND_PLACEHOLDER)


def label_underscores(value: Column | str) -> Column:
    return F.translate(as_column(value), "_", " ")


def label_disposition(value: Column | str) -> Column:
    """``CUSTOMER_DAMAGED_x`` -> ``CUSTOMER DAMAGED X``: only first letters change."""
    words = F.split(label_underscores(value), " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))),
        " ",
    )


def label_month(ym: Column | str) -> Column:
    """``2024-01`` -> ``Jan '24``; missing month -> empty label."""
    first_day = F.concat(as_column(ym), F.lit("-01")).try_cast("date")
    return F.coalesce(F.date_format(first_day, "MMM ''yy"), F.lit(""))
