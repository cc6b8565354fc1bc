"""Dates of which the month may be unknown, and ranges of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PartialDate = tuple[int, int | None]
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Fixed patterns: the shapes of a date in the order in which they are tried at each place of a text.
_SHAPES = (
    ("present", r"\b(?:present|current|ongoing|now|till date)\b"),
    ("ymd", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"),
    ("dmy", r"\d{1,2}[-/]\d{1,2}[-/]\d{4}"),
    ("name", r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?,?\s+\d{4}"),
    ("ym", r"\d{4}[-/]\d{1,2}(?!\d)"),
    ("my", r"\d{1,2}[-/]\d{4}"),
    ("y", r"\b(?:19|20)\d{2}\b"),
)
TOKEN = re.compile("|".join(f"(?P<{name}>{shape})" for name, shape in _SHAPES), re.I)
#: Two dates further apart than so many characters are two dates, not a range.
GAP = 12


def _month(y: int, m: int) -> PartialDate:
    return (y, m) if 1 <= m <= 12 else (y, None)


def _read(m: re.Match) -> PartialDate | str:
    kind, n = m.lastgroup, [int(x) for x in re.findall(r"\d+", m.group())]
    if kind == "present":
        return "present"
    if kind == "name":
        return n[0], _MONTHS.index(m.group()[:3].lower()) + 1
    if kind in ("ymd", "ym"):
        return _month(n[0], n[1])
    if kind == "my":
        return _month(n[1], n[0])
    if kind == "dmy":
        # Day and month can be told apart only if one of them is no month or both are the same.
        fits = {x for x in n[:2] if x <= 12}
        return n[2], fits.pop() if len(fits) == 1 else None
    return n[0], None


def tokens(s: object) -> list[tuple[int, int, PartialDate | str]]:
    return [(m.start(), m.end(), _read(m)) for m in TOKEN.finditer(str(s))]


def parse(s: object) -> PartialDate | None:
    """The first date of a text."""
    return next((d for _, _, d in tokens(s) if d != "present"), None)


def parse_range(s: str) -> tuple[PartialDate, PartialDate | None, bool] | None:
    """(start, end, is current) of a text that begins with a date: since one, up to now, or up to another close by."""
    found = tokens(s)
    if not found or found[0][2] == "present":
        return None
    begin, stop, start = found[0]
    if re.search(r"\bsince\b", s[:begin], re.I):
        return start, None, True
    if len(found) > 1 and found[1][0] - stop <= GAP:
        return (start, None, True) if found[1][2] == "present" else (start, found[1][2], False)
    return None


def render(d: PartialDate | None) -> str | None:
    return None if d is None else f"{d[0]:04d}-{d[1]:02d}" if d[1] else f"{d[0]:04d}"


def month_index(d: PartialDate, bound: str) -> int:
    return d[0] * 12 + (d[1] or (1 if bound == "start" else 12)) - 1


def parse_col(c: Column) -> Column:
    """struct(y, m) of the first date of a text, null without one."""

    @F.pandas_udf("struct<y:int,m:int>")
    def udf(s: pd.Series) -> pd.DataFrame:
        got = [(parse(v) if v is not None else None) or (None, None) for v in s]
        return pd.DataFrame({"y": pd.array([g[0] for g in got], dtype="Int32"), "m": pd.array([g[1] for g in got], dtype="Int32")})

    d = udf(c)
    return F.when(d["y"].isNotNull(), d)


def render_col(y: Column, m: Column) -> Column:
    return F.when(m.isNull(), F.format_string("%04d", y)).otherwise(F.format_string("%04d-%02d", y, m))


def month_index_col(y: Column, m: Column, bound: str) -> Column:
    """Months since year 0; a year alone begins in January and ends in December."""
    return y * 12 + F.coalesce(m, F.lit(1 if bound == "start" else 12)) - 1
