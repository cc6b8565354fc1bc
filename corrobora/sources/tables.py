"""Candidate tables as evidence, by built-in functions: what the file parsers do for files, for rows that are tables already."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions import contacts
from corrobora.functions.skills import canonical_skill, country_code_col
from corrobora.functions.values import value_or_null

COLUMNS = ["source_id", "source_type", "record_id", "updated_at", "field_path", "value", "raw_value", "method", "order_index", "normalized", "locator"]


def _struct(**parts: Column) -> Column:
    """Canonical JSON of a struct: keys sorted, nulls kept."""
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})


def _skill_json(aliases: dict[str, str] | None):  # noqa: ANN202
    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        import json

        return s.map(lambda v: None if v is None else json.dumps(dict(zip(("name", "canonical"), canonical_skill(v, aliases), strict=True)), sort_keys=True, ensure_ascii=False))

    return udf


def _atoms(rows: DataFrame, kind: str, updated: Column, fields: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """Long form: fields are (path, values as an array, raw text, method); an empty array gives no atom."""
    items = [F.transform(F.coalesce(values, F.array().cast("array<string>")), _item(path, raw, method)) for path, values, raw, method in fields]
    long = rows.select("source_id", F.lit(kind).alias("source_type"), "record_id", updated.alias("updated_at"), F.posexplode(F.flatten(F.array(*items))).alias("order_index", "a"))
    normal = F.col("a.field_path") != "phones_raw"
    return long.select("source_id", "source_type", "record_id", "updated_at", "a.field_path", "a.value", "a.raw_value", "a.method", "order_index", normal.alias("normalized"), F.lit(None).cast("string").alias("locator"))


def _item(path: str, raw: Column, method: str):  # noqa: ANN202
    return lambda v: F.struct(F.lit(path).alias("field_path"), v.alias("value"), raw.alias("raw_value"), F.lit(method).alias("method"))


def _one(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.array(c))


def _phones(rows: DataFrame, column: str, region: str | None) -> DataFrame:
    """rows with good (E.164) and open numbers of a cell; each number is normalised once, in one Arrow batch."""

    @F.pandas_udf("struct<good:array<string>,open:array<string>>")
    def udf(cells: pd.Series) -> pd.DataFrame:
        import re

        good, still = [], []
        for cell in cells:
            parts = [p.strip() for p in re.split(r"[/;,]|\band\b", cell or "") if any(c.isdigit() for c in p)]
            done = [(contacts.to_e164(p, region), p) for p in parts]
            good.append([e for e, _ in done if e])
            still.append([p for e, p in done if not e])
        return pd.DataFrame({"good": good, "open": still})

    return rows.withColumn("__phones", udf(value_or_null(F.col(column))))


def ats_atoms(ats: DataFrame, skills: dict[str, str] | None = None, region: str | None = None) -> DataFrame:
    """Atoms of t1_ats rows. Null marks give none; packed skills are split at plain delimiters only."""
    v = lambda c: value_or_null(F.col(c))
    items = F.filter(F.transform(F.split(F.coalesce(v("skills"), F.lit("")), r"[,;|\n\t•]"), lambda s: F.btrim(s, F.lit(' "[]'))), lambda s: s != "")
    code = country_code_col(v("country"))
    place = _struct(city=v("city"), region=v("region"), country=code)
    job = _struct(company=v("currentemployer"), title=v("designation"), start=F.lit(None).cast("array<int>"), end=F.lit(None).cast("array<int>"), is_current=F.lit(True), summary=F.lit(None).cast("string"))
    mails = F.filter(F.transform(F.array(v("emailaddress"), v("email_id")), lambda e: contacts.email_normalized(e)), lambda e: e.isNotNull())
    years = F.regexp_replace(F.col("totalyearsexperience").cast("string"), r"\.0$", "")
    exploded = ats.select("record_id", F.explode(F.array_distinct(items)).alias("s")).withColumn("j", _skill_json(skills)(F.col("s")))
    rows = _phones(ats, "phonenumber", region)
    base = _atoms(rows, "ats_json", v("lastupdated"), [
        ("full_name", _one(v("candidatename")), F.col("candidatename"), "direct_field"), ("emails", mails, F.col("emailaddress"), "direct_field"),
        ("phones", F.col("__phones.good"), F.col("phonenumber"), "direct_field"), ("phones_raw", F.col("__phones.open"), F.col("phonenumber"), "direct_field"),
        ("years_experience", _one(years), years, "direct_field"), ("location", F.when(F.coalesce(v("city"), v("region"), code).isNotNull(), F.array(place)), place, "direct_field"),
        ("experience", F.when(F.coalesce(v("currentemployer"), v("designation")).isNotNull(), F.array(job)), job, "direct_field"),
    ])
    found = exploded.join(ats.select("record_id", "source_id", v("lastupdated").alias("updated_at")).distinct(), "record_id")
    more = found.select("source_id", F.lit("ats_json").alias("source_type"), "record_id", "updated_at", F.lit("skills").alias("field_path"), F.col("j").alias("value"), F.col("s").alias("raw_value"), F.lit("dict:skill_alias_v1").alias("method"), F.lit(50).alias("order_index"), F.lit(True).alias("normalized"), F.lit(None).cast("string").alias("locator"))
    return base.unionByName(more)


def roster_atoms(roster: DataFrame, region: str | None = None) -> DataFrame:
    """Atoms of t1_roster rows."""
    v = lambda c: value_or_null(F.col(c))
    mails = F.filter(F.transform(contacts.split_emails(F.coalesce(v("email"), F.lit(""))), lambda e: contacts.email_normalized(e)), lambda e: e.isNotNull())
    job = _struct(company=v("current_company"), title=v("title"), start=F.lit(None).cast("array<int>"), end=F.lit(None).cast("array<int>"), is_current=F.lit(True), summary=F.lit(None).cast("string"))
    return _atoms(_phones(roster, "phone", region), "recruiter_csv", F.lit(None).cast("string"), [
        ("full_name", _one(v("name")), F.col("name"), "direct_field"), ("emails", mails, F.col("email"), "direct_field"),
        ("phones", F.col("__phones.good"), F.col("phone"), "direct_field"), ("phones_raw", F.col("__phones.open"), F.col("phone"), "direct_field"),
        ("experience", F.when(F.coalesce(v("current_company"), v("title")).isNotNull(), F.array(job)), job, "direct_field"),
    ])


def evidence_atoms(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """The evidence table in the shape of atoms: kinds and methods folded, null marks left out."""
    kind = F.regexp_replace(F.lower(F.trim("source_type")), r"[\s_-]+", "_")
    stamp = records.groupBy("record_id").agg(F.max(value_or_null(F.col("updated_at"))).alias("updated_at"))
    e = evidence.withColumn("value", value_or_null(F.col("value_text"))).where(F.col("value").isNotNull()).join(stamp, "record_id", "left")
    job = _struct(company=F.col("value"), title=F.lit(None).cast("string"), start=F.lit(None).cast("array<int>"), end=F.lit(None).cast("array<int>"), is_current=F.lit(True), summary=F.lit(None).cast("string"))
    is_job = F.col("field_path") == "current_company"
    return e.select(
        "source_id", kind.alias("source_type"), "record_id", "updated_at", F.when(is_job, "experience").otherwise(F.col("field_path")).alias("field_path"),
        F.when(is_job, job).otherwise(F.col("value")).alias("value"), "raw_value", "method", "order_index", "normalized", F.lit(None).cast("string").alias("locator"),
    )
