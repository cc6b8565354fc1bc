"""What counts as a value: blanks and the null marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no value.
NULL_MARKS = ("", "n/a", "-", "—", "none", "null", "unknown")

#: Blanks around a text, of any kind.
_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Text without blanks of any kind around it."""
    return F.regexp_replace(c, _EDGES, "")


def value_or_null(c: Column) -> Column:
    """Stripped text, or null for a null mark."""
    s = strip(c)
    return F.when(~F.lower(s).isin(*NULL_MARKS), s)
