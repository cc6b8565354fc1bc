"""Execution of a compiled query: one select over the canonical profiles, so Catalyst prunes what no field reads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions import partial_dates as dates
from corrobora.functions.contacts import to_e164
from corrobora.functions.skills import canonical_skill, country_code
from corrobora.functions.text import fold
from corrobora.plans.config import ALL, Field, Query, Step

#: Named normalizers as scalar functions that return None for a value they can't normalize.
SCALARS = {
    "E164": to_e164, "canonical": lambda v: canonical_skill(v)[0] or None, "YYYY-MM": lambda v: dates.render(dates.parse(v)), "ISO3166": country_code, "lower": fold,
}
REASONS = {
    "E164": "not E.164-normalizable without region context: ", "canonical": "empty after skill folding: ", "YYYY-MM": "no parseable date in: ", "ISO3166": "unknown country: ", "lower": "",
}


def normalizer(name: str, array: bool) -> object:
    """A normalizer as an Arrow UDF; of an array all elements must normalize, else the whole is null."""
    f = SCALARS[name]

    def over(v: object) -> object:
        if v is None:
            return None
        if not array:
            return f(v)
        out = [f(x) for x in v]
        return None if any(x is None for x in out) else out

    @F.pandas_udf("array<string>" if array else "string")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([over(v) for v in s], dtype=object)

    return udf


def resolve(steps: tuple[Step, ...], root: Column | None = None) -> Column:
    """The column at a path: null on a missing field or index, mapped elements without the missing ones, an empty array present."""
    (name, index), rest = steps[0], steps[1:]
    c = F.col(name) if root is None else root[name]
    if index == ALL:
        if not rest:
            return F.filter(c, lambda x: x.isNotNull())
        return F.filter(F.transform(c, lambda x: resolve(rest, x)), lambda x: x.isNotNull())
    if index is not None:
        c = F.get(c, F.lit(index))
    return resolve(rest, c) if rest else c


def failure(name: str, array: bool) -> object:
    """Why a value doesn't normalize: the value as text, and the reason with the first element that fails; null if it does."""
    f = SCALARS[name]

    @F.pandas_udf("struct<raw_value:string,reason:string>")
    def udf(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            items = [] if v is None else list(v) if array else [v]
            bad = next((x for x in items if f(x) is None), None)
            text = str(items if array else v)
            out.append((None, None) if bad is None else (text if len(text) <= 80 else f"{text[:77]}...", f"{REASONS[name]}{bad!r}"))
        return pd.DataFrame(out, columns=["raw_value", "reason"], dtype=object)

    return udf


def provenance(query: Query) -> Column:
    """Provenance under the names of the query: entries of fields it doesn't read are dropped; sorted; one per field, source and method."""

    def renamed(f: Field) -> Column:
        n = len(f.source)
        visible = F.filter("provenance", lambda p: (p["field"] == f.source) | p["field"].startswith(f"{f.source}[") | p["field"].startswith(f"{f.source}."))
        return F.transform(visible, lambda p: F.struct(F.concat(F.lit(f.path), F.substring(p["field"], n + 1, 1000)).alias("field"), p["source"].alias("source"), p["method"].alias("method"), p["alternatives"].alias("alternatives")))

    entries = F.array_sort(F.flatten(F.array(*[renamed(f) for f in query.fields])))
    same = lambda a, b: (a["field"] == b["field"]) & (a["source"] == b["source"]) & (a["method"] == b["method"])
    return F.aggregate(entries, F.slice(entries, 1, 0), lambda acc, p: F.when(F.exists(acc, lambda q: same(q, p)), acc).otherwise(F.concat(acc, F.array(p))))


def _nested(items: list[tuple[tuple[str, ...], Column]]) -> list[Column]:
    """Columns with structs built for the inner output paths, in the order in which they first appear."""
    out: list[Column] = []
    for name in dict.fromkeys(p[0] for p, _ in items):
        inner = [(p[1:], c) for p, c in items if p[0] == name]
        out.append((inner[0][1] if not inner[0][0] else F.struct(*_nested(inner))).alias(name))
    return out


def project(profiles: DataFrame, query: Query) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, validation, notes) of the profiles under a query.

    records: candidate_key and the query's fields, without profiles that lack a required field (or, with on_missing=error,
    any). validation: candidate_id, field, problem. notes: candidate_id, field, raw_value, reason of values that exist but
    don't normalize, which count as missing. With on_missing=omit nulls are left out by the sink; an inner object whose
    required parts are all missing excludes its profile there, as its schema asks for the object.
    """
    found, errors, notes = [], [], []
    for f in query.fields:
        raw = c = resolve(f.steps)
        if f.normalize:
            c = normalizer(f.normalize, f.type.endswith(ALL))(raw)
            why = failure(f.normalize, f.type.endswith(ALL))(raw)
            notes.append(F.when(raw.isNotNull() & why["reason"].isNotNull(), F.struct(F.lit(f.path).alias("field"), why["raw_value"].alias("raw_value"), why["reason"].alias("reason"))))
        found.append((f.out, c))
        if f.required or query.on_missing == "error":
            errors.append(F.when(c.isNull(), F.struct(F.lit(f.path).alias("field"), F.lit("required_missing" if f.required else "missing").alias("problem"))))
    if query.on_missing == "omit":
        for parent in dict.fromkeys(f.out[:-1] for f in query.fields if len(f.out) > 1):
            inside = [c for (out, c) in found if out[: len(parent)] == parent]
            errors.append(F.when(F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in inside]).isNull(), F.struct(F.lit("<schema>").alias("field"), F.lit(f"{'/'.join(parent)} is a required property").alias("problem"))))
    cols = _nested(found)
    if query.include_provenance:
        cols.append(provenance(query).alias("provenance"))
    if query.include_confidence:
        pairs = F.filter(F.array(*[F.struct(F.lit(f.path).alias("key"), F.try_element_at("field_confidence", F.lit(f.top)).alias("value")) for f in query.fields]), lambda x: x["value"].isNotNull())
        cols.append(F.struct(F.col("overall_confidence").alias("overall"), F.map_from_entries(pairs).alias("fields")).alias("confidence"))
    bad = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<struct<field:string,problem:string>>")
    noted = F.filter(F.array(*notes), lambda e: e.isNotNull()) if notes else F.array().cast("array<struct<field:string,raw_value:string,reason:string>>")
    keep = [F.col("years_lexeme").alias("__years_lexeme")] if "years_lexeme" in profiles.columns and any(f.source == "years_experience" for f in query.fields) else []
    at = profiles.select(F.col("candidate_id").alias("candidate_key"), bad.alias("__bad"), noted.alias("__noted"), *keep, *cols)
    records = at.where(F.size("__bad") == 0).drop("__bad", "__noted")
    validation = at.select(F.col("candidate_key").alias("candidate_id"), F.explode("__bad").alias("e")).select("candidate_id", "e.*")
    noted_rows = at.select(F.col("candidate_key").alias("candidate_id"), F.explode("__noted").alias("e")).select("candidate_id", "e.*")
    return records, validation, noted_rows
