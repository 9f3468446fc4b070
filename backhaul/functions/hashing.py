"""Row identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column


def row_hash(*parts: Column | str) -> Column:
    """md5 of the parts joined by a vertical bar; a missing part counts as ``''``.

    ``concat_ws`` alone would drop NULLs and shift the parts, hence the coalesce.
    """
    return F.md5(F.concat_ws("|", *[F.coalesce(as_column(p), F.lit("")) for p in parts]))


def packed_hash(hashed: Column | str) -> Column:
    """A row hash as bytes, to be shuffled and compared: the 16 that an md5 in hexadecimal text
    stands for. Any other text is its own bytes with 17 more, so no two texts become the same."""
    text = as_column(hashed)
    other = F.concat(F.to_binary(text, F.lit("utf-8")), F.lit(b"\0" * 17))
    return F.when(text.rlike(r"\A[0-9a-f]{32}\z"), F.unhex(text)).otherwise(other)
