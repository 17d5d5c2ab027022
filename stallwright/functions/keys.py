"""Keys compare without regard to letter case and to blanks at either end; a blank key is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def norm_key(column: str | Column) -> Column:
    """Trimmed, lower-case key; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS))), F.lit(""))


def norm_type(column: str | Column) -> Column:
    """An event type in upper case, each blank or hyphen inside as an underscore."""
    return F.upper(F.translate(norm_key(column), " -", "__"))


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)
