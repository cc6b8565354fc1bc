"""E-mail addresses, links and phone numbers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = r"(?i)\bhttps?://[^\s<>\"')\]]+|\b(?:www\.)?(?:linkedin\.com|github\.com)/[^\s<>\"')\]]+"
PHONE = r"\+?\d[\d\s\-().]{6,}\d"
_EXTENSION = r"(?i)\s*(?:ext\.?|extension|x)\s*\d+\s*$"


def email_normalized(raw: Column) -> Column:
    """Trimmed, lower-case address, or null if the text is none."""
    s = F.btrim(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), F.lit(" .,;<>()[]\"'"))
    return F.when(s.rlike(f"^(?:{EMAIL})$"), F.lower(s))


def email_match_key(email: Column) -> Column:
    """Form for matching: without +tag; on gmail also without dots, googlemail being gmail."""
    local = F.substring_index(F.substring_index(F.lower(email), "@", 1), "+", 1)
    domain = F.regexp_replace(F.lower(email), "^[^@]*@", "")
    gmail = domain.isin("gmail.com", "googlemail.com")
    return F.when(gmail, F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@gmail.com"))).otherwise(F.concat(local, F.lit("@"), domain))


def email_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1)


def split_emails(cell: Column) -> Column:
    return F.filter(F.split(cell, r"(?U)[;,\s]+"), lambda x: x != "")


def url_clean(url: Column) -> Column:
    u = F.regexp_replace(F.trim(url), r"[.,;:]+$", "")
    return F.when(F.lower(u).startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def url_host(clean: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(clean), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), r"^www\.", "")


def url_bucket(url: Column) -> Column:
    """linkedin, github or other, by the end of the host."""
    host = url_host(url_clean(url))
    return F.when(host.endswith("linkedin.com"), "linkedin").when(host.endswith("github.com"), "github").otherwise("other")


def url_match_key(url: Column) -> Column:
    """Host and path in lower case: scheme, www, query, fragment and last slash aside."""
    clean = F.lower(url_clean(url))
    path = F.regexp_extract(clean, r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#;]*)", 1)
    return F.regexp_replace(F.concat(url_host(clean), path), "/+$", "")


def url_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL})"), 1)


def phone_candidates(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1), lambda x: F.trim(x))


def split_phones(cell: Column) -> Column:
    """Parts of a cell between / ; , or the word and, that have a digit."""
    return F.filter(F.transform(F.split(cell, r"[/;,]|\band\b"), lambda x: F.trim(x)), lambda x: x.rlike(r"\d"))


def strip_extension(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), _EXTENSION, "")


#: Country code, regions, trunk prefix and national numbers of the regions that are known; others are reported, never guessed.
PLANS = (
    ("1", ("US", "CA"), "1", r"(?!555)[2-9](?!11)\d{2}[2-9]\d{6}"),
    ("91", ("IN",), "0", r"[6-9]\d{9}|[1-5]\d{9}"),
    ("44", ("GB",), "0", r"7[1-57-9]\d{8}|[1-3]\d{8,9}|8\d{9}"),
    ("33", ("FR",), "0", r"[1-79]\d{8}"),
    ("49", ("DE",), "0", r"1[5-7]\d{8,9}|[2-9]\d{5,10}"),
    ("81", ("JP",), "0", r"[789]0\d{8}|[1-9]\d{8}"),
    ("31", ("NL",), "0", r"6\d{8}|[1-57]\d{8}"),
    ("34", ("ES",), "", r"[6-9]\d{8}"),
    ("39", ("IT",), "", r"3\d{8,9}|0\d{5,10}"),
    ("353", ("IE",), "0", r"8[3-9]\d{7}|[1-79]\d{6,8}"),
    ("41", ("CH",), "0", r"7[4-9]\d{7}|[2-6]\d{8}"),
    ("46", ("SE",), "0", r"7[02369]\d{7}|[1-69]\d{6,8}"),
    ("48", ("PL",), "", r"[1-9]\d{8}"),
    ("61", ("AU",), "0", r"[2378]\d{8}|4\d{8}"),
    ("65", ("SG",), "", r"[3689]\d{7}"),
    ("86", ("CN",), "0", r"1[3-9]\d{9}|[2-9]\d{8,10}"),
    ("55", ("BR",), "0", r"[1-9]{2}9?\d{8}"),
    ("82", ("KR",), "0", r"1[0-9]\d{7,8}|[2-6]\d{7,9}"),
    ("52", ("MX",), "01", r"[1-9]\d{9}"),
    ("971", ("AE",), "0", r"5[024-68]\d{7}|[2-4679]\d{7}"),
    ("972", ("IL",), "0", r"5\d{8}|[2-489]\d{7}"),
)
_BY_CODE = {code: (trunk, re.compile(number)) for code, _, trunk, number in PLANS}
_BY_REGION = {r: code for code, regions, _, _ in PLANS for r in regions}


def to_e164(raw: object, region: str | None = None) -> str | None:
    """E.164, or None. A + decides the country by itself; without it and without a region nothing is assumed."""
    s = re.sub(_EXTENSION, "", str(raw).strip())
    digits = re.sub(r"\D", "", s)
    if re.search(r"[A-Za-z]", s) or not digits:
        return None
    if s.startswith("+"):
        code = next((digits[:n] for n in (3, 2, 1) if digits[:n] in _BY_CODE), None)
        national = digits[len(code) :] if code else ""
    else:
        code, national = _BY_REGION.get(region or ""), digits
    if code is None:
        return None
    trunk, number = _BY_CODE[code]
    for n in (national, national.removeprefix(trunk) if trunk else national):
        if number.fullmatch(n):
            return f"+{code}{n}"
    return None


def e164_col(raw: Column, region: Column | None = None) -> Column:
    @F.pandas_udf("string")
    def udf(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else to_e164(v, g) for v, g in zip(s, r, strict=True)], dtype=object)

    return udf(raw, F.lit(None).cast("string") if region is None else region)
