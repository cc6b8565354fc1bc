"""Merge: one canonical profile per cluster, each field by survivorship, with confidence, provenance and notes."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions import contacts
from corrobora.functions import partial_dates as dates
from corrobora.functions.text import round6, unaccent, unaccent_col
from corrobora.operators import confidence as C
from corrobora.operators.periods import merge_periods
from corrobora.session import cut

SCALARS = ("full_name", "headline", "location", "links.linkedin", "links.github")


def descending(text: Column) -> Column:
    """A text that sorts the other way round, so that one minimum can mix both directions; longer before its own beginnings."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def preference() -> Column:
    """Survivorship as one sortable struct: trust, method, recency (as text, missing last), source, record, position, value."""
    return F.struct(
        (-F.col("trust")).alias("t"), (-F.col("reliability")).alias("r"), descending(F.coalesce("updated_at", F.lit(""))).alias("d"),
        F.col("source_id"), F.col("record_id"), F.col("order_index"), F.col("value").alias("v"), F.col("method"),
    )


def with_strength(atoms: DataFrame) -> DataFrame:
    a = atoms.withColumns({"trust": C.trust(F.col("source_type")), "reliability": C.reliability(F.col("method"))})
    return a.withColumn("strength", F.col("trust") * F.col("reliability")).withColumn("pref", preference())


def value_table(atoms: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, agreement, support, best, sources): everything survivorship and confidence need, by two partial aggregates."""
    per_source = atoms.groupBy(*by, "value", "source_id").agg(F.max("strength").alias("s"), F.min("pref").alias("p"))
    return per_source.groupBy(*by, "value").agg(C.noisy_or(F.col("s")).alias("agreement"), F.sum("s").alias("support"), F.min("p").alias("best"), F.array_sort(F.collect_set("source_id")).alias("sources"))


def winners(values: DataFrame) -> DataFrame:
    """(cluster_id, field_path, value, confidence, source_id, method, alternatives): the winner of each scalar field.

    Locations compare by their number of known parts first and stay whole.
    """
    parts = F.size(F.filter(F.map_values(F.from_json("value", "map<string,string>")), lambda x: x.isNotNull() & (x != "")))
    complete = F.when(F.col("field_path") == "location", parts).otherwise(0)
    g = values.groupBy("cluster_id", "field_path").agg(
        F.min_by(F.struct("value", "agreement", "support", "best"), F.struct((-complete).alias("c"), F.col("best"))).alias("w"),
        F.sum("support").alias("total"), F.array_sort(F.collect_set("value")).alias("all"),
    )
    return g.select(
        "cluster_id", "field_path", "w.value", round6(F.col("w.agreement") * F.col("w.support") / F.col("total")).alias("confidence"),
        F.col("w.best.source_id").alias("source_id"), F.col("w.best.method").alias("method"), F.array_except("all", F.array("w.value")).alias("alternatives"),
    )


def personal_site(url: Column, folded_name: Column) -> Column:
    """Whether the first label of a link's host holds a word of the name of four characters or more."""
    label = F.substring_index(contacts.url_host(url), ".", 1)
    return F.coalesce(F.exists(F.filter(F.split(folded_name, "[^a-z0-9]+"), lambda t: F.length(t) >= 4), lambda t: F.contains(label, t)), F.lit(False))


_ENTRY = (
    "array<struct<company:string,title:string,start:string,end:string,is_current:boolean,summary:string,confidence:double,source_id:string,method:string,"
    "s:int,e:int,reason:string,raw_range:string,first_order:string>>"
)
_ENTRY_FIELDS = ("company", "title", "start", "end", "is_current", "summary", "confidence", "source_id", "method", "s", "e", "reason", "raw_range", "first_order")


def _same_post(a: dict, b: dict, as_of: dates.PartialDate) -> bool:
    """Two posts at one company: by overlap if both are dated, else if both are current or their titles agree."""
    if a["start"] and b["start"]:
        span = [(dates.month_index(x["start"], "start"), dates.month_index(x["end"] or as_of, "end")) for x in (a, b)]
        return span[0][0] <= span[1][1] and span[1][0] <= span[0][1]
    if a["is_current"] and b["is_current"]:
        return True
    return bool(a["title"] and b["title"] and unaccent(a["title"]) == unaccent(b["title"]))


def _posts(claims: list[dict], as_of: dates.PartialDate | None) -> list[dict]:
    """The entries of one person at one company: posts that are the same, directly or through others, become one."""
    rows = []
    for r in sorted(claims, key=lambda r: r["rank"]):
        x = json.loads(r["value"])
        rows.append(x | {"start": tuple(x["start"]) if x["start"] else None, "end": tuple(x["end"]) if x["end"] else None, "row": r})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and rows[i]["company"] and _same_post(rows[i], rows[j], as_of or (9999, 12)):
                keep, gone = sorted((group[i], group[j]))
                group = [keep if g == gone else g for g in group]
    return [dict(zip(_ENTRY_FIELDS, _entry([x for x, k in zip(rows, group, strict=True) if k == g], as_of), strict=True)) for g in sorted(set(group))]


def _extreme(found: list, bound: str, pick) -> dates.PartialDate | None:  # noqa: ANN001
    """The outermost date among those with a known month, or among all if none has one."""
    known = [d for d in found if d and d[1]] or [d for d in found if d]
    return pick(known, key=lambda d: dates.month_index(d, bound)) if known else None


def _entry(posts: list[dict], as_of: dates.PartialDate | None) -> tuple:
    pick = lambda k: next((p[k] for p in posts if p.get(k) is not None), None)
    start, current = _extreme([p["start"] for p in posts], "start", min), any(p["is_current"] for p in posts)
    end = None if current else _extreme([p["end"] for p in posts], "end", max)
    strongest: dict[str, float] = {}
    for p in posts:
        strongest[p["row"]["source_id"]] = max(strongest.get(p["row"]["source_id"], 0.0), p["row"]["strength"])
    left = 1.0
    for s in sorted(strongest):
        left *= 1.0 - strongest[s]
    s = e = reason = None
    if start and (end or (current and as_of)):
        s, e, now = dates.month_index(start, "start"), dates.month_index(end or as_of, "end"), dates.month_index(as_of, "end") if as_of else None
        if now is not None and s > now:
            s, e, reason = None, None, "future_dated_range"
        elif e < s:
            s, e, reason = None, None, "inverted_date_range"
        elif now is not None and e > now:
            e, reason = now, "future_end_clamped"
    best = posts[0]["row"]
    text = f"{pick('company')}: {dates.render(start)} -> {dates.render(end) or 'present'}" if reason else None
    order = min(p["row"]["pool"] for p in posts)
    return pick("company"), pick("title"), dates.render(start), dates.render(end), current, pick("summary"), round(1.0 - left, 6), best["source_id"], best["method"], s, e, reason, text, order


def merged_posts(atoms: DataFrame, as_of: dates.PartialDate | None) -> DataFrame:
    """Experience entries of each cluster, one task per cluster and company. Equal claims of a source are folded first."""
    x = atoms.where(F.col("field_path") == "experience")
    company = F.coalesce(F.get_json_object("value", "$.company"), F.lit(""))
    x = x.withColumn("at", F.when(company == "", F.concat(F.lit("\u0000"), "record_id", F.lit("|"), F.col("order_index"))).otherwise(unaccent_col(company)))
    pool = F.concat_ws("\u0001", "value", "source_type", "source_id", "record_id", F.lpad(F.col("order_index").cast("string"), 9, "0"), "method")
    folded = x.groupBy("cluster_id", "at", "value", "source_id").agg(F.max("strength").alias("strength"), F.min("pref").alias("p"), F.min(pool).alias("pool"))
    rows = folded.select(
        "cluster_id", "at", "value", "source_id", "strength", "pool", F.col("p.method").alias("method"),
        F.concat_ws("\u0001", F.format_string("%.6f", F.col("p.t") + 2), F.format_string("%.6f", F.col("p.r") + 2), "p.d", "p.source_id", "p.record_id", F.lpad(F.col("p.order_index").cast("string"), 9, "0"), "p.v").alias("rank"),
    )

    @F.pandas_udf(_ENTRY)
    def entries(groups: pd.Series) -> pd.Series:
        return pd.Series([_posts(list(g), as_of) for g in groups], dtype=object)

    each = rows.groupBy("cluster_id", "at").agg(F.collect_list(F.struct("value", "source_id", "strength", "pool", "method", "rank")).alias("claims"))
    return each.select("cluster_id", F.explode(entries("claims")).alias("x")).select("cluster_id", "x.*")


def merged_schools(atoms: DataFrame) -> DataFrame:
    """(cluster_id, inst, institution, degree, field, end_year, confidence, source_id, method): education by institution and year; each part from the most preferred atom that has it."""
    x = atoms.where(F.col("field_path") == "education").withColumn("e", F.from_json("value", "institution string, degree string, field string, end_year int"))
    x = x.withColumns({"inst": unaccent_col(F.coalesce("e.institution", F.lit(""))), "year": F.col("e.end_year")})
    parts = ["institution", "degree", "field", "end_year"]
    first = lambda c: F.min(F.when(F.col(f"e.{c}").isNotNull(), F.struct("pref", F.col(f"e.{c}").alias("x")))).alias(c)
    per_source = x.groupBy("cluster_id", "inst", "year", "source_id").agg(F.max("strength").alias("s"), F.min("pref").alias("p"), *[first(c) for c in parts])
    g = per_source.groupBy("cluster_id", "inst", "year").agg(C.noisy_or(F.col("s")).alias("agreement"), F.min("p").alias("best"), *[F.min(c).alias(c) for c in parts])
    return g.select("cluster_id", "inst", *[F.col(f"{c}.x").alias(c) for c in parts], round6(F.col("agreement")).alias("confidence"), F.col("best.source_id").alias("source_id"), F.col("best.method").alias("method"))


def ranked_array(rows: DataFrame, out: str, order: list[Column], item: Column, key: str = "cluster_id") -> DataFrame:
    """(key, out): the items of each key in order."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), item.alias("x")))).alias("a"))
    return g.select(key, F.transform("a", lambda s: s["x"]).alias(out))


def prov(field: Column, source: Column, method: Column, alternatives: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(field.alias("field"), source.alias("source"), method.alias("method"), (none if alternatives is None else alternatives).alias("alternatives"))


@dataclass
class Merged:
    """profiles in the canonical schema; notes: source_id, field, raw_value, reason."""

    profiles: DataFrame
    notes: DataFrame


def _candidate_seeds(atoms: DataFrame, clusters: DataFrame, contested: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster_id, candidate_id): hash of the smallest uncontested e-mail key, else phone, else name and company, else record."""
    value = F.col("value")
    strong = atoms.where(F.col("field_path").isin("emails", "phones"))
    kind = F.when(F.col("field_path") == "emails", "email").otherwise("phone")
    key = F.when(F.col("field_path") == "emails", contacts.email_match_key(value)).otherwise(value)
    seeds = strong.select("cluster_id", F.concat(kind, F.lit(":"), key).alias("key"), (kind != "email").alias("later")).distinct()
    seeds = seeds.join(contested, "key", "left_anti").groupBy("cluster_id").agg(F.min(F.struct("later", "key"))["key"].alias("seed"))
    pool = F.struct("value", "source_type", "source_id", "record_id", "order_index", "method")
    job = atoms.where(F.col("field_path") == "experience").withColumn("c", F.get_json_object("value", "$.company")).where(F.length("c") > 0)
    job = job.groupBy("cluster_id").agg(F.min_by("c", pool).alias("company"))
    at = clusters.select("cluster_id", "flags").join(seeds, "cluster_id", "left").join(names, "cluster_id", "left").join(job, "cluster_id", "left")
    named = F.concat(F.lit("name+company:"), "folded_name", F.lit("|"), unaccent_col(F.coalesce("company", F.lit(""))))
    own = F.concat(F.lit("record:"), "cluster_id")
    seed = F.when(F.array_contains("flags", "multi_identity_source"), own).otherwise(F.coalesce("seed", F.when(F.col("folded_name").isNotNull(), named), own))
    return at.select("cluster_id", F.substring(F.sha2(seed, 256), 1, 16).alias("candidate_id"))


def merge(atoms: DataFrame, members: DataFrame, clusters: DataFrame, contested: DataFrame, as_of: dates.PartialDate | None) -> Merged:
    """Canonical profiles of all clusters.

    atoms: as scanned; members: record_id, cluster_id; clusters: cluster_id, flags; contested: key. Every group is folded by
    partial aggregates per value and source, so a cluster with many repeated records costs no more than its distinct values.
    """
    a = cut(with_strength(atoms.join(members, "record_id")))
    by = ["cluster_id", "field_path"]
    plain = a.where(~F.col("field_path").isin("experience", "education", "phones_raw", "phones", "years_experience"))
    values = cut(value_table(plain, by))
    scalars = cut(winners(values.where(F.col("field_path").isin(*SCALARS))))
    names = scalars.where("field_path = 'full_name'").select("cluster_id", "value", unaccent_col(F.col("value")).alias("folded_name"))

    # Links that carry the name become the portfolio, unless one is stated.
    others = values.where("field_path = 'links.other'").join(names.select("cluster_id", "folded_name"), "cluster_id", "left")
    stated = values.where("field_path = 'links.portfolio'")
    others = others.join(stated.select("cluster_id", F.lit(True).alias("stated")).distinct(), "cluster_id", "left")
    others = cut(others.withColumn("own", personal_site(F.col("value"), F.col("folded_name")) & F.col("stated").isNull()).drop("folded_name", "stated"))
    portfolio = stated.unionByName(others.where("own").drop("own").withColumn("field_path", F.lit("links.portfolio")))
    scalars = cut(scalars.unionByName(winners(portfolio)))

    # Numbers without a country are tried again with the country of the merged location.
    country = scalars.where("field_path = 'location'").select("cluster_id", F.get_json_object("value", "$.country").alias("country"))
    raw = a.where("field_path = 'phones_raw'").join(country, "cluster_id", "left")
    raw = cut(raw.withColumn("e164", contacts.e164_col(F.col("value"), F.col("country"))))
    second = raw.where(F.col("e164").isNotNull()).withColumns({"field_path": F.lit("phones"), "method": F.concat(F.lit("phones_pass2:"), "country"), "value": F.col("e164")})
    second = with_strength(second.select(*[c for c in a.columns if c not in ("trust", "reliability", "strength", "pref")]))
    why = F.when(F.trim("value").startswith("+") | F.col("country").isNotNull(), "invalid_number").otherwise("no_region_context")
    notes = raw.where(F.col("e164").isNull()).select("source_id", F.lit("phones").alias("field"), F.col("value").alias("raw_value"), why.alias("reason"))
    phones = value_table(a.where("field_path = 'phones'").unionByName(second.select(a.columns)), by)

    sets = values.where("field_path = 'emails'").unionByName(phones)
    sets = cut(sets.withColumn("confidence", round6(F.col("agreement"))))
    skills = a.where("field_path = 'skills'").withColumns({"flag": F.get_json_object("value", "$.canonical") == "true", "value": F.get_json_object("value", "$.name")})
    known = skills.groupBy("cluster_id", "value").agg(F.bool_or("flag").alias("canonical"))
    skills = value_table(skills, by).withColumn("confidence", round6(F.col("agreement"))).join(known, ["cluster_id", "value"])
    posts = cut(merged_posts(a, as_of))
    schools = cut(merged_schools(a))
    notes = notes.unionByName(posts.where(F.col("reason").isNotNull()).select("source_id", F.lit("experience").alias("field"), F.col("raw_range").alias("raw_value"), "reason"))
    years = _years(a, posts)

    down = (-F.col("confidence"))
    arrays = [
        ranked_array(sets.where(f"field_path = '{f}'"), f, [down, F.col("value")], F.struct("value", "confidence", F.col("best.source_id").alias("source_id"), F.col("best.method").alias("method")))
        for f in ("emails", "phones")
    ] + [
        ranked_array(skills, "skills", [down, F.col("value")], F.struct(F.col("value").alias("name"), "canonical", "confidence", "sources")),
        ranked_array(others.where("NOT own").withColumn("confidence", round6(F.col("agreement"))), "other_links", [F.col("value")], F.struct("value", "confidence")),
        ranked_array(posts, "experience", [F.col("start").isNull(), -_index(F.col("start")), F.coalesce("company", F.lit("")), F.col("first_order")], F.struct("company", "title", "start", "end", "is_current", "summary", "confidence", "source_id", "method")),
        ranked_array(schools, "education", [-F.coalesce("end_year", F.lit(0)), F.col("inst")], F.struct("institution", "degree", "field", "end_year", "confidence", "source_id", "method")),
    ]
    wide = scalars.groupBy("cluster_id").pivot("field_path", [*SCALARS, "links.portfolio"]).agg(F.first(F.struct("value", "confidence", "source_id", "method", "alternatives")))
    wide = wide.toDF(*[c.replace(".", "_") for c in wide.columns])
    p = clusters.select("cluster_id", "flags").join(_candidate_seeds(a, clusters, contested, names), "cluster_id").join(wide, "cluster_id", "left")
    for part in [*arrays, years]:
        p = p.join(part, "cluster_id", "left")
    return Merged(cut(_profile(p)), notes)


def _index(start: Column) -> Column:
    return F.coalesce(F.substring(start, 1, 4).cast("int") * 12 + F.coalesce(F.nullif(F.substring(start, 6, 2), F.lit("")).cast("int"), F.lit(1)), F.lit(0))


def _years(atoms: DataFrame, posts: DataFrame) -> DataFrame:
    """(cluster_id, years): derived from the union of the posts' months if there are any, else the stated value that ranks first.

    Values within one year of the winner agree with it; all others take from its support.
    """
    months = merge_periods(posts.where(F.col("s").isNotNull()).select("cluster_id", "s", "e"), "cluster_id").groupBy("cluster_id").agg(F.sum(F.col("e") - F.col("s") + 1).alias("n"))
    derived = months.select("cluster_id", F.round(F.col("n").cast("decimal(12,4)") / 12, 1).cast("double").cast("string").alias("value"), F.lit("derived:experience").alias("source_id"), F.lit("derived").alias("record_id"), F.lit("derived").alias("source_type"), F.lit("derived:experience_intervals_v1").alias("method"), F.lit(0).alias("order_index"), F.lit(None).cast("string").alias("updated_at"))
    stated = atoms.where("field_path = 'years_experience'").select(*derived.columns)
    all_ = with_strength(derived.unionByName(stated)).withColumn("is_derived", F.col("source_type") == "derived")
    first = all_.groupBy("cluster_id").agg(F.min_by(F.struct("value", "source_id", "method"), F.struct(~F.col("is_derived"), "pref")).alias("w"))
    at = all_.join(first, "cluster_id").withColumn("agrees", F.abs(F.col("value").cast("double") - F.col("w.value").cast("double")) <= 1.0)
    own = at.where("agrees").groupBy("cluster_id", "source_id").agg(F.max("strength").alias("s")).groupBy("cluster_id").agg(C.noisy_or(F.col("s")).alias("agreement"), F.sum("s").alias("mine"))
    total = at.groupBy("cluster_id", "source_id", "value").agg(F.max("strength").alias("s")).groupBy("cluster_id").agg(F.sum("s").alias("total"), F.array_sort(F.collect_set("value")).alias("all"))
    y = first.join(own, "cluster_id").join(total, "cluster_id")
    score = round6(F.col("agreement") * F.col("mine") / F.col("total"))
    return y.select("cluster_id", F.struct("w.value", score.alias("confidence"), "w.source_id", "w.method", F.array_except("all", F.array("w.value")).alias("alternatives")).alias("years"))


def _profile(p: DataFrame) -> DataFrame:
    """The canonical schema from the merged parts."""
    scalar = {"full_name": "full_name", "headline": "headline", "location": "location", "links_linkedin": "links.linkedin", "links_github": "links.github", "links_portfolio": "links.portfolio", "years": "years_experience"}
    empty = F.array().cast("array<string>")
    one = [F.when(F.col(c).isNotNull(), F.array(prov(F.lit(f), F.col(f"{c}.source_id"), F.col(f"{c}.method"), F.col(f"{c}.alternatives")))) for c, f in scalar.items()]

    def placed(c: str) -> Column:
        return F.transform(F.col(c), lambda x, i: prov(F.concat(F.lit(f"{c}["), i.cast("string"), F.lit("]")), x["source_id"], x["method"]))

    many = [placed(c) for c in ("emails", "phones", "experience", "education")]
    kind = "array<struct<field:string,source:string,method:string,alternatives:array<string>>>"
    provenance = F.array_sort(F.flatten(F.array(*[F.coalesce(x, F.array().cast(kind)) for x in [*one, *many]])))
    top = lambda c: F.when(F.size(c) > 0, F.array_max(F.transform(c, lambda x: x["confidence"])))
    links = F.greatest(*[F.col(f"links_{b}.confidence") for b in ("linkedin", "github", "portfolio")], top("other_links"))
    scores = {
        "education": top("education"), "emails": top("emails"), "experience": top("experience"), "full_name": F.col("full_name.confidence"), "headline": F.col("headline.confidence"), "links": links,
        "location": F.col("location.confidence"), "phones": top("phones"), "skills": top("skills"), "years_experience": F.col("years.confidence"),
    }
    conf = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in scores.items()]), lambda x: x["value"].isNotNull()))
    values = lambda c: F.coalesce(F.transform(c, lambda x: x["value"]), empty)
    q = p.withColumn("field_confidence", conf)
    return q.select(
        "cluster_id", "candidate_id", "flags", F.col("full_name.value").alias("full_name"), values("emails").alias("emails"), values("phones").alias("phones"),
        F.from_json("location.value", "city string, region string, country string").alias("location"),
        F.struct(F.col("links_linkedin.value").alias("linkedin"), F.col("links_github.value").alias("github"), F.col("links_portfolio.value").alias("portfolio"), values("other_links").alias("other")).alias("links"),
        F.col("headline.value").alias("headline"), F.col("years.value").cast("double").alias("years_experience"), F.col("years.value").alias("years_lexeme"),
        F.coalesce("skills", F.array().cast("array<struct<name:string,canonical:boolean,confidence:double,sources:array<string>>>")).alias("skills"),
        F.coalesce(F.transform("experience", lambda x: F.struct(*[x[c].alias(c) for c in ("company", "title", "start", "end", "is_current", "summary")])), F.array().cast("array<struct<company:string,title:string,start:string,end:string,is_current:boolean,summary:string>>")).alias("experience"),
        F.coalesce(F.transform("education", lambda x: F.struct(*[x[c].alias(c) for c in ("institution", "degree", "field", "end_year")])), F.array().cast("array<struct<institution:string,degree:string,field:string,end_year:int>>")).alias("education"),
        provenance.alias("provenance"), "field_confidence", round6(C.overall(F.col("field_confidence"))).alias("overall_confidence"),
    )


def evidence_trace(atoms: DataFrame, members: DataFrame, most: int = 300) -> DataFrame:
    """Every atom behind the profiles, for looking into a merge: its cluster, strength, and raw text of at most so many characters.

    Off the way of a run: nothing reads it unless it is asked for.
    """
    a = with_strength(atoms.join(members, "record_id"))
    return a.select("cluster_id", "field_path", "source_id", "source_type", "record_id", "order_index", "method", "value", F.substring("raw_value", 1, most).alias("raw"), "locator", "normalized", F.round("strength", 6).alias("strength"))


def derive_as_of(atoms: DataFrame) -> tuple[dates.PartialDate | None, str]:
    """The latest month of the records' own timestamps, else of the claims about work and education; None without any.

    Both tiers are one global aggregate; equal months keep the smallest record, so the result doesn't depend on order.
    """
    d = lambda c: F.struct(dates.month_index_col(F.col(f"{c}.y"), F.col(f"{c}.m"), "end").alias("i"), F.col(f"{c}.y").alias("y"), F.col(f"{c}.m").alias("m"))
    stamps = atoms.where(F.col("updated_at").isNotNull()).select("updated_at").distinct().withColumn("d", dates.parse_col(F.col("updated_at"))).where(F.col("d").isNotNull())
    row = stamps.agg(F.max(d("d")).alias("x")).first()
    if row.x is not None:
        return (row.x.y, row.x.m), "timestamps"
    pair = F.from_json("value", "start array<int>, end array<int>, end_year int")
    claims = atoms.where(F.col("field_path").isin("experience", "education")).withColumn("v", pair)
    both = claims.select(F.explode(F.array(F.col("v.start"), F.col("v.end"), F.when(F.col("v.end_year").isNotNull(), F.array("v.end_year", F.lit(None).cast("int"))))).alias("d"))
    both = both.where(F.col("d").isNotNull()).select(F.struct(F.get("d", F.lit(0)).alias("y"), F.get("d", F.lit(1)).alias("m")).alias("d"))
    row = both.agg(F.max(d("d")).alias("x")).first()
    return ((row.x.y, row.x.m) if row.x is not None else None), "claims"
