"""Queries that run whole operators (parsers, identity, merge) over a data folder, and SQL that computes the same from the tables.

Parsers get what they get in a scan: the content of files. The files are made from the rows of a table, one each, so no group
of rows is gathered; what the parser must find in them is read off the table by SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions import contacts, dictionaries
from corrobora.functions.text import unaccent_col
from corrobora.functions.values import value_or_null
from corrobora.operators import identity, merge
from corrobora.plans.config import compile_query
from corrobora.plans.projection import project
from corrobora.session import table
from corrobora.sources.formats import clean_pages
from corrobora.sources.scan import scan, source_type
from corrobora.sources.tables import ats_atoms, evidence_atoms

NOW = (2026, 8)
_NOW = NOW[0] * 12 + NOW[1] - 1


def _parsed(files: DataFrame) -> DataFrame:
    """Atoms of files (source_id, content), by the scan's own detection and parsers."""
    return scan(files.withColumns({"source_type": source_type(F.col("source_id")), "content": F.col("content").cast("binary")})).atoms


def _json(*fields: str) -> Column:
    """Fields of the JSON value; an array's null element reads as null."""
    read = lambda f: F.nullif(F.get_json_object("value", f"$.{f}"), F.lit("null")) if f.endswith("]") else F.get_json_object("value", f"$.{f}")
    return F.array_join(F.array(*[F.coalesce(read(f), F.lit("")) for f in fields]), "|")


def parse_roster(spark: SparkSession, d: str) -> DataFrame:
    """Roster rows as CSV files through the parser; phones as written."""
    cell = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    cols = ("name", "email", "phone", "current_company", "title")
    line = F.concat_ws(",", *[cell(c) for c in cols])
    files = table(spark, d, "t1_roster").select(F.concat(F.replace("record_id", F.lit("#"), F.lit("_")), F.lit(".csv")).alias("source_id"), F.concat(F.lit(",".join(cols) + "\n"), line, F.lit("\n")).alias("content"))
    a = _parsed(files).withColumn("field", F.regexp_replace("field_path", "_raw$", ""))
    text = F.when(F.col("field") == "phones", F.col("raw_value")).when(F.col("field") == "experience", _json("company", "title")).otherwise(F.col("value"))
    return a.select("source_id", F.col("field").alias("field_path"), text.alias("text"))


_B = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MARKS = ", ".join(f"'{m}'" for m in dictionaries.NULL_MARKERS)
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def _stripped(c: str) -> str:
    return f"regexp_replace(nfc_normalize({c}), '^{_B}+|{_B}+$', '', 'g')"


def _known(c: str) -> str:
    return f"CASE WHEN trim(lower({_stripped(c)}), ' .') NOT IN ({_MARKS}) THEN {_stripped(c)} END"


def _mail(c: str) -> str:
    """SQL of an address, null if the text is none."""
    s = f"trim({_stripped(c)}, ' .,;<>()[]\"''')"
    return f"CASE WHEN regexp_full_match({s}, '{_EMAIL}') THEN lower({s}) END"


PARSE_ROSTER = rf"""
WITH r AS (SELECT replace(record_id, '#', '_') || '.csv' AS source_id, {", ".join(f"{_known(c)} AS {c}" for c in ("name", "email", "phone", "current_company", "title"))} FROM t1_roster),
e AS (SELECT source_id, unnest(regexp_split_to_array(email, '(?:[;,]|{_B})+')) AS x FROM r WHERE email IS NOT NULL),
p AS (SELECT source_id, unnest(regexp_split_to_array(phone, '[/;,]|\band\b')) AS x FROM r WHERE phone IS NOT NULL)
SELECT source_id, 'full_name' AS field_path, name AS text FROM r WHERE name IS NOT NULL
UNION ALL SELECT source_id, 'emails', {_mail("x")} FROM e WHERE {_mail("x")} IS NOT NULL
UNION ALL SELECT source_id, 'phones', {_stripped("x")} FROM p WHERE regexp_matches(x, '[0-9]')
UNION ALL SELECT source_id, 'experience', coalesce(current_company, '') || '|' || coalesce(title, '') FROM r WHERE current_company IS NOT NULL OR title IS NOT NULL
"""


def parse_ats(spark: SparkSession, d: str) -> DataFrame:
    """t1_ats rows as JSON files through the parser, with the record's own time."""
    names = {
        "candidatename": "candidateName", "emailaddress": "emailAddress", "email_id": "email_id", "phonenumber": "phoneNumber", "currentemployer": "currentEmployer", "designation": "designation",
        "skills": "skills", "totalyearsexperience": "totalYearsExperience", "city": "city", "region": "region", "country": "country", "lastupdated": "lastUpdated",
    }
    content = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()]))
    a = _parsed(table(spark, d, "t1_ats").select(F.concat(F.replace("record_id", F.lit("#"), F.lit("_")), F.lit(".json")).alias("source_id"), content.alias("content")))
    a = a.withColumn("field", F.regexp_replace("field_path", "_raw$", ""))
    at = lambda f: F.col("field") == f
    text = (
        F.when(at("phones"), F.col("raw_value")).when(at("experience"), _json("company", "title")).when(at("location"), _json("city", "region", "country")).when(at("skills"), _json("name", "canonical")).otherwise(F.col("value"))
    )
    return a.select("source_id", F.coalesce("updated_at", F.lit("")).alias("updated_at"), F.col("field").alias("field_path"), text.alias("text"))


def _values(rows: dict[str, str], names: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"(VALUES {', '.join(f'({quote(k)}, {quote(v)})' for k, v in rows.items())}) {names}"


PARSE_ATS = rf"""
WITH r AS (SELECT replace(record_id, '#', '_') || '.json' AS source_id, CASE WHEN lastupdated <> '' THEN {_stripped("lastupdated")} ELSE '' END AS u, phonenumber, skills, totalyearsexperience AS years, country AS land,
  {", ".join(f"{_known(c)} AS {c}" for c in ("candidatename", "emailaddress", "email_id", "currentemployer", "designation", "city", "region"))}, {_known("phonenumber")} AS phone FROM t1_ats),
s AS (SELECT source_id, u, x, regexp_replace(lower({_stripped("x")}), '[^a-z0-9+#.\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]', ' ', 'g') AS f
  FROM (SELECT source_id, u, unnest(string_split(skills, ',')) AS x FROM r WHERE skills <> '') WHERE {_stripped("x")} <> '' AND trim(lower({_stripped("x")}), ' .') NOT IN ({_MARKS})),
n AS (SELECT source_id, u, trim(regexp_replace(regexp_replace(f, '{_B}+v?\d+(\.\d+)*\n?$', ''), '{_B}+', ' ', 'g'), ' .') AS f FROM s),
l AS (SELECT source_id, u, city, region, code FROM r LEFT JOIN {_values(dictionaries.COUNTRY_ALIASES, "k(alias, code)")} ON alias = trim(lower({_stripped("land")}), ' .') AND land <> '')
SELECT source_id, coalesce(u, '') AS updated_at, 'full_name' AS field_path, candidatename AS text FROM r WHERE candidatename IS NOT NULL
UNION ALL SELECT source_id, coalesce(u, ''), 'emails', {_mail("emailaddress")} FROM r WHERE {_mail("emailaddress")} IS NOT NULL
UNION ALL SELECT source_id, coalesce(u, ''), 'emails', {_mail("email_id")} FROM r WHERE {_mail("email_id")} IS NOT NULL
UNION ALL SELECT source_id, coalesce(u, ''), 'phones', phonenumber FROM r WHERE phone IS NOT NULL
UNION ALL SELECT source_id, coalesce(u, ''), 'skills', coalesce(name, f) || '|' || CASE WHEN name IS NULL THEN 'false' ELSE 'true' END FROM n LEFT JOIN {_values(dictionaries.SKILL_ALIASES, "k(alias, name)")} ON alias = f
UNION ALL SELECT source_id, coalesce(u, ''), 'years_experience', CAST(years AS VARCHAR) FROM r WHERE years IS NOT NULL
UNION ALL SELECT source_id, coalesce(u, ''), 'location', coalesce(city, '') || '|' || coalesce(region, '') || '|' || coalesce(code, '') FROM l WHERE coalesce(city, region, code) IS NOT NULL
UNION ALL SELECT source_id, coalesce(u, ''), 'experience', coalesce(currentemployer, '') || '|' || coalesce(designation, '') FROM r WHERE currentemployer IS NOT NULL OR designation IS NOT NULL
"""


def parse_linkedin(spark: SparkSession, d: str) -> DataFrame:
    """Posts as profile files through the parser: partial dates, and current only without an end."""
    p = table(spark, d, "linkedin_positions")
    date = lambda y, m, n: F.struct(F.col(y).alias("year"), F.col(m).alias("month")).alias(n)
    content = F.to_json(F.struct(F.array(F.struct(F.col("companyname").alias("companyName"), "title", date("start_year", "start_month", "startDate"), date("end_year", "end_month", "endDate"), F.col("iscurrent").alias("isCurrent"))).alias("positions")))
    name = F.concat(F.lit("linkedin_"), F.coalesce(F.replace("record_id", F.lit("#"), F.lit("_")), F.lit("none")), F.lit("_"), F.coalesce(F.col("pos").cast("string"), F.lit("x")), F.lit(".json"))
    a = _parsed(p.select(name.alias("source_id"), content.alias("content")))
    return a.select("source_id", _json("company", "title", "start[0]", "start[1]", "end[0]", "end[1]", "is_current").alias("text"))


PARSE_LINKEDIN = f"""
WITH p AS (SELECT 'linkedin_' || coalesce(replace(record_id, '#', '_'), 'none') || '_' || coalesce(CAST(pos AS VARCHAR), 'x') || '.json' AS source_id, {_known("companyname")} AS company, {_known("title")} AS title,
  nullif(start_year, 0) AS sy, nullif(start_month, 0) AS sm, nullif(end_year, 0) AS ey, nullif(end_month, 0) AS em, coalesce(iscurrent, false) AS cur FROM linkedin_positions)
SELECT source_id, coalesce(company, '') || '|' || coalesce(title, '') || '|' || coalesce(CAST(sy AS VARCHAR), '') || '|' || CASE WHEN sy IS NULL THEN '' ELSE coalesce(CAST(sm AS VARCHAR), '') END || '|' ||
  coalesce(CAST(ey AS VARCHAR), '') || '|' || CASE WHEN ey IS NULL THEN '' ELSE coalesce(CAST(em AS VARCHAR), '') END || '|' || CASE WHEN cur AND ey IS NULL THEN 'true' ELSE 'false' END AS text FROM p
"""


def parse_notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes through the grammar: labelled names and titles, and addresses."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    a = _parsed(docs.select(F.concat(F.lit("note_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_id"), F.col("text").alias("content")))
    return a.where(F.col("field_path").isin("full_name", "headline", "emails")).select("source_id", "field_path", F.col("value").alias("text"))


def _label(words: str) -> str:
    return rf"(?im)^(?:{words}){_B}*[:\-]{_B}*(.+)$"


PARSE_NOTES = f"""
WITH t AS (SELECT 'note_' || doc_id || '.txt' AS source_id, text AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT source_id, unnest(regexp_extract_all(t, '{_EMAIL}')) AS x FROM t)
SELECT source_id, 'full_name' AS field_path, {_stripped(f"regexp_extract(t, '{_label('name|candidate')}', 1)")} AS text FROM t WHERE regexp_matches(t, '{_label("name|candidate")}')
UNION ALL SELECT source_id, 'headline', {_stripped(f"regexp_extract(t, '{_label('role|title')}', 1)")} FROM t WHERE regexp_matches(t, '{_label("role|title")}')
UNION ALL SELECT source_id, 'emails', {_mail("x")} FROM e WHERE {_mail("x")} IS NOT NULL
"""


def hyphen_heal(spark: SparkSession, d: str) -> DataFrame:
    """Words cut at line ends are joined, by the operator that cleans pages; the texts by hash."""

    @F.pandas_udf("string")
    def healed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: clean_pages([t]))

    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").withColumn("h", healed("text"))
    return t.select("doc_id", (F.length("text") - F.length("h")).alias("n_removed"), F.md5("h").alias("hash"))


HYPHEN_HEAL = r"SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g')) AS INT) AS n_removed, md5(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g')) AS hash FROM documents WHERE text IS NOT NULL"


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """The latest month of the records' own timestamps."""
    month, _ = merge.derive_as_of(ats_atoms(table(spark, d, "t1_ats")))
    return spark.createDataFrame([(None if month is None else month[0] * 12 + (month[1] or 12) - 1,)], "as_of int")


AS_OF = "SELECT max(CAST(substr(trim(lastupdated), 1, 4) AS INT) * 12 + CAST(substr(trim(lastupdated), 6, 2) AS INT) - 1) AS as_of FROM t1_ats WHERE regexp_matches(trim(lastupdated), '^[0-9]{4}-[0-9]{2}')"


def phone_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many roster numbers become E.164 as they are, with a region, or not."""
    r = table(spark, d, "t1_roster").select(F.explode(contacts.split_phones(F.col("phone"))).alias("part"))
    p = r.where(F.length(F.regexp_replace(contacts.strip_extension(F.col("part")), "[^0-9]", "")) >= 9)
    p = p.withColumn("own", contacts.e164_col(F.col("part"))).withColumn("us", contacts.e164_col(F.col("part"), F.lit("US")))
    what = F.when(F.col("own").isNotNull(), "own_country_code").when(F.col("us").isNotNull(), "with_region").when(F.col("part").startswith("+"), "invalid_number").otherwise("no_region_context")
    return p.groupBy(what.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("own", "us")).alias("first"), F.max(F.coalesce("own", "us")).alias("last"))


#: The plan of North America without lookahead, which SQL lacks; the conditions stand beside it.
_US = r"[2-9]\d{2}[2-9]\d{6}"
_PLANS = ", ".join(f"('{code}', '{trunk}', '{_US if code == '1' else number}')" for code, _, trunk, number in contacts.PLANS)
_FITS = "regexp_full_match({0}, re) AND (code <> '1' OR (NOT starts_with({0}, '555') AND substr({0}, 2, 2) <> '11'))"


def _e164_sql(code: str, national: str) -> str:
    cut = f"substr({national}, length(trunk) + 1)"
    return (
        f"(SELECT CASE WHEN {_FITS.format(national)} THEN '+' || code || {national} WHEN trunk <> '' AND starts_with({national}, trunk) AND {_FITS.format(cut)} THEN '+' || code || {cut} END FROM plans WHERE code = {code})"
    )


PHONE_OUTCOMES = rf"""
WITH plans AS (SELECT * FROM (VALUES {_PLANS}) v(code, trunk, re)),
p AS (SELECT trim(unnest(regexp_split_to_array(phone, '[/;,]|\band\b'))) AS part FROM t1_roster WHERE phone IS NOT NULL),
n AS (SELECT part, trim(regexp_replace(part, '(?i)\s*(?:ext\.?|extension|x)\s*\d+\s*$', '')) AS s FROM p WHERE regexp_matches(part, '[0-9]')),
q AS (SELECT part, s, CASE WHEN NOT regexp_matches(s, '[A-Za-z]') THEN regexp_replace(s, '[^0-9]', '', 'g') END AS g FROM n WHERE length(regexp_replace(s, '[^0-9]', '', 'g')) >= 9),
c AS (SELECT *, CASE WHEN starts_with(s, '+') THEN (SELECT max(code) FROM plans WHERE starts_with(g, code) AND length(code) = (SELECT max(length(code)) FROM plans WHERE starts_with(g, code))) END AS code FROM q),
o AS (SELECT part, {_e164_sql("c.code", "substr(c.g, length(c.code) + 1)")} AS own, CASE WHEN NOT starts_with(s, '+') THEN {_e164_sql("'1'", "c.g")} END AS us FROM c)
SELECT CASE WHEN own IS NOT NULL THEN 'own_country_code' WHEN us IS NOT NULL THEN 'with_region' WHEN starts_with(part, '+') THEN 'invalid_number' ELSE 'no_region_context' END AS outcome,
  count(*) AS n, min(coalesce(own, us)) AS "first", max(coalesce(own, us)) AS "last" FROM o GROUP BY 1
"""


def _identity(spark: SparkSession, d: str) -> identity.Identity:
    return identity.resolve(evidence_atoms(table(spark, d, "evidence"), table(spark, d, "source_records")))


def resolved_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Records of evidence in clusters by guarded union, with the keys that tie them and their flags."""
    c = _identity(spark, d).clusters
    return c.select("cluster_id", F.size("record_ids").alias("n_records"), F.array_join("match_keys_used", " ").alias("keys"), F.array_join("flags", " ").alias("flags"))


def resolved_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Unions refused because names contradict, with both sides as they stood, and the contested key."""
    return _identity(spark, d).refusals.select(F.array_join("records", " ").alias("records"), "key", "reason")


def _folded(c: str) -> str:
    return f"lower(strip_accents({_stripped(c)}))"


_SAME = "len(list_filter(t, lambda p: len(list_filter(u, lambda q: p = q OR (length(p) = 1 AND starts_with(q, p)) OR (length(q) = 1 AND starts_with(p, q)))) > 0)) > 0"
_CONTRA = f"len(list_filter(x.n, lambda t: len(list_filter(y.n, lambda u: NOT (len(t) = 0 OR len(u) = 0 OR {_SAME}))) > 0)) > 0"
_EVIDENCE = rf"""
e AS (SELECT record_id, field_path, regexp_replace(lower(trim(source_type)), '[\s_-]+', '_', 'g') AS st, {_stripped("value_text")} AS v, order_index, method FROM evidence
  WHERE lower({_stripped("value_text")}) NOT IN ('', 'n/a', '-', '—', 'none', 'null', 'unknown'))"""
_RESOLVE = rf"""
f AS (SELECT DISTINCT record_id, st, field_path, CASE WHEN field_path = 'emails' THEN 'email' ELSE 'phone' END AS kind,
  CASE WHEN field_path <> 'emails' THEN v WHEN regexp_replace(lower(v), '^[^@]*@', '') IN ('gmail.com', 'googlemail.com') THEN replace(split_part(split_part(lower(v), '@', 1), '+', 1), '.', '') || '@gmail.com'
    ELSE split_part(split_part(lower(v), '@', 1), '+', 1) || '@' || regexp_replace(lower(v), '^[^@]*@', '') END AS key FROM e WHERE field_path IN ('emails', 'phones')),
many AS (SELECT DISTINCT record_id FROM (SELECT record_id, field_path FROM f WHERE st IN ('notes_txt', 'resume') GROUP BY ALL HAVING count(*) >= 2)),
soft AS (SELECT record_id, name || '|' || company AS key FROM
  (SELECT record_id, {_folded("first(v ORDER BY order_index, v, method)")} AS name FROM e WHERE field_path = 'full_name' GROUP BY record_id)
  JOIN (SELECT record_id, {_folded("first(v ORDER BY order_index, v || chr(34), method)")} AS company FROM e WHERE field_path = 'current_company' GROUP BY record_id) USING (record_id)
  WHERE record_id NOT IN (SELECT record_id FROM f)),
k AS (SELECT DISTINCT record_id, kind, key, CASE kind WHEN 'email' THEN 0 ELSE 1 END AS rank FROM f WHERE record_id NOT IN (SELECT record_id FROM many) UNION ALL SELECT record_id, 'soft', key, 3 FROM soft),
b AS (SELECT kind, key, rank, min(record_id) AS base FROM k GROUP BY ALL HAVING count(*) > 1),
tries AS (SELECT b.*, k.record_id AS other FROM b JOIN k USING (kind, key) WHERE k.record_id <> base),
g AS (SELECT DISTINCT base AS a, other AS b FROM tries UNION SELECT other, base FROM tries),
reach(id, c) AS (SELECT a, a FROM g UNION SELECT g.b, reach.c FROM reach JOIN g ON g.a = reach.id WHERE reach.c < g.b),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
seq AS (SELECT comp.c AS comp, base, other, kind || ':' || key AS label, row_number() OVER (PARTITION BY comp.c ORDER BY rank, key, kind, other) AS k FROM tries JOIN comp ON comp.id = base),
names AS (SELECT record_id, list(DISTINCT list_filter(regexp_split_to_array({_folded("v")}, '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')) AS n FROM e WHERE field_path = 'full_name' GROUP BY record_id),
step(comp, k, st, a, b, label, ok) AS (
  SELECT c, CAST(0 AS BIGINT), list({{'r': id, 'c': id, 'n': coalesce(n, [])}}), '', '', '', true FROM comp LEFT JOIN names ON record_id = id GROUP BY c
  UNION ALL
  SELECT comp, k, CASE WHEN ok AND a <> b THEN list_transform(st, lambda x: {{'r': x.r, 'c': CASE WHEN x.c = greatest(a, b) THEN least(a, b) ELSE x.c END, 'n': x.n}}) ELSE st END, a, b, label, ok FROM (
    SELECT *, a = b OR len(list_filter(list_filter(st, lambda x: x.c = a), lambda x: len(list_filter(list_filter(st, lambda y: y.c = b), lambda y: {_CONTRA})) > 0)) = 0 AS ok FROM (
      SELECT seq.comp, seq.k, s.st, list_filter(s.st, lambda x: x.r = seq.base)[1].c AS a, list_filter(s.st, lambda x: x.r = seq.other)[1].c AS b, seq.label
      FROM step s JOIN seq ON seq.comp = s.comp AND seq.k = s.k + 1))),
final AS (SELECT x.r AS record_id, x.c AS cluster FROM (SELECT unnest(st) AS x FROM step JOIN (SELECT comp, max(k) AS k FROM step GROUP BY comp) USING (comp, k)))
"""


def _clusters_sql(evidence: str, sep: str) -> str:
    return f"""
WITH RECURSIVE {evidence}, {_RESOLVE},
m AS (SELECT record_id, coalesce(cluster, record_id) AS cluster_id FROM (SELECT DISTINCT record_id FROM e) LEFT JOIN final USING (record_id)),
used AS (SELECT cluster AS cluster_id, string_agg(DISTINCT label, '{sep}' ORDER BY label) AS keys, bool_or(starts_with(label, 'soft:')) AS soft FROM step JOIN final ON final.record_id = step.a WHERE step.k > 0 AND ok AND a <> b GROUP BY cluster)
SELECT cluster_id, CAST(count(*) AS INT) AS n_records, coalesce(max(keys), '') AS keys,
  array_to_string(list_filter([CASE WHEN bool_or(m.record_id IN (SELECT record_id FROM many)) THEN 'multi_identity_source' END, CASE WHEN count(*) > 1 AND coalesce(bool_or(soft), false) THEN 'soft_key_merge' END], lambda f: f IS NOT NULL), '{sep}') AS flags
FROM m LEFT JOIN used USING (cluster_id) GROUP BY cluster_id
"""


def _refusals_sql(evidence: str) -> str:
    return f"WITH RECURSIVE {evidence}, {_RESOLVE} SELECT least(a, b) || ' ' || greatest(a, b) AS records, label AS key, 'suspect_shared_identifier' AS reason FROM step WHERE k > 0 AND NOT ok"


RESOLVED_CLUSTERS, RESOLVED_REFUSALS = _clusters_sql(_EVIDENCE, " "), _refusals_sql(_EVIDENCE)


def _value(c: str) -> str:
    return f"CASE WHEN lower({_stripped(c)}) NOT IN ('', 'n/a', '-', '—', 'none', 'null', 'unknown') THEN {_stripped(c)} END"


#: The evidence of t1_ats and t1_roster rows, with numbers by their plans; field "other" stands for all that ties nobody.
PEOPLE_EVIDENCE = rf"""
plans AS (SELECT * FROM (VALUES {_PLANS}) v(code, trunk, re)),
a AS (SELECT record_id, {", ".join(f"{_value(c)} AS {c}" for c in ("candidatename", "emailaddress", "email_id", "phonenumber", "currentemployer", "designation", "skills", "city", "region", "country"))}, totalyearsexperience AS years FROM t1_ats),
o AS (SELECT record_id, {", ".join(f"{_value(c)} AS {c}" for c in ("name", "email", "phone", "current_company", "title"))} FROM t1_roster),
mails AS (SELECT record_id, {_mail("x")} AS v FROM (SELECT record_id, unnest([emailaddress, email_id]) AS x FROM a UNION ALL SELECT record_id, unnest(regexp_split_to_array(email, '(?:[;,]|{_B})+')) FROM o WHERE email IS NOT NULL)),
parts AS (SELECT record_id, trim(unnest(regexp_split_to_array(x, '[/;,]|\band\b'))) AS part FROM (SELECT record_id, phonenumber AS x FROM a UNION ALL SELECT record_id, phone FROM o) WHERE x IS NOT NULL),
digits AS (SELECT record_id, s, CASE WHEN NOT regexp_matches(s, '[A-Za-z]') THEN regexp_replace(s, '[^0-9]', '', 'g') END AS g FROM
  (SELECT record_id, trim(regexp_replace(part, '(?i)\s*(?:ext\.?|extension|x)\s*\d+\s*$', '')) AS s FROM parts WHERE regexp_matches(part, '[0-9]'))),
coded AS (SELECT *, (SELECT max(code) FROM plans WHERE starts_with(g, code) AND length(code) = (SELECT max(length(code)) FROM plans WHERE starts_with(g, code))) AS code FROM digits WHERE starts_with(s, '+')),
numbers AS (SELECT record_id, {_e164_sql("coded.code", "substr(coded.g, length(coded.code) + 1)")} AS v FROM coded),
e AS (SELECT record_id, field_path, 'table' AS st, v, 0 AS order_index, '' AS method FROM (
  SELECT record_id, 'full_name' AS field_path, candidatename AS v FROM a UNION ALL SELECT record_id, 'full_name', name FROM o
  UNION ALL SELECT record_id, 'emails', v FROM mails UNION ALL SELECT record_id, 'phones', v FROM numbers
  UNION ALL SELECT record_id, 'current_company', currentemployer FROM a UNION ALL SELECT record_id, 'current_company', current_company FROM o
  UNION ALL SELECT record_id, 'other', 'x' FROM digits UNION ALL SELECT record_id, 'other', title FROM o UNION ALL SELECT record_id, 'other', coalesce(designation, city, region, CAST(years AS VARCHAR), nullif(trim(skills, ',;| []"'), '')) FROM a
  UNION ALL SELECT record_id, 'other', code FROM a JOIN {_values(dictionaries.COUNTRY_ALIASES, "k(alias, code)")} ON alias = trim(lower(country), ' .')) WHERE v IS NOT NULL)
"""
GUARDED_CLUSTERS, UNION_REFUSALS = _clusters_sql(PEOPLE_EVIDENCE, ","), _refusals_sql(PEOPLE_EVIDENCE)


def merged_fields(spark: SparkSession, d: str) -> DataFrame:
    """Profiles merged from evidence by its given clusters: winners, lists, ids and confidence."""
    records = table(spark, d, "source_records")
    members = records.select("record_id", "cluster_id").where("record_id IS NOT NULL AND cluster_id IS NOT NULL").distinct()
    clusters = members.select("cluster_id").distinct().withColumn("flags", F.array().cast("array<string>"))
    p = merge.merge(evidence_atoms(table(spark, d, "evidence"), records), members, clusters, spark.createDataFrame([], "key string"), NOW).profiles
    conf = lambda f: F.round(F.coalesce(F.try_element_at("field_confidence", F.lit(f)), F.lit(0.0)) + 2e-6, 3).alias(f"c_{f}")
    return p.select(
        "cluster_id", "candidate_id", "full_name", "headline", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "location.city", "location.region", "location.country",
        F.array_join(F.transform("experience", lambda x: x["company"]), "|").alias("companies"), "years_experience", conf("full_name"), conf("emails"), conf("phones"), conf("experience"),
    )


_MERGE = rf"""
t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in dictionaries.SOURCE_TRUST.items())}) x(st, trust)),
r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in dictionaries.METHOD_RELIABILITY.items())}) x(mf, rel)),
c AS (SELECT DISTINCT record_id, cluster_id FROM source_records WHERE record_id IS NOT NULL AND cluster_id IS NOT NULL),
up AS (SELECT record_id, max(CASE WHEN lower({_stripped("updated_at")}) NOT IN ('', 'n/a', '-', '—', 'none', 'null', 'unknown') THEN {_stripped("updated_at")} END) AS upd FROM source_records GROUP BY record_id),
w AS (SELECT cluster_id, field_path, {_stripped("value_text")} AS value, source_id, e.record_id, order_index, method, coalesce(upd, '') AS upd, CAST(coalesce(trust, 0) AS DOUBLE) AS trust, CAST(coalesce(rel, 0) AS DOUBLE) AS rel,
    CAST(coalesce(trust, 0) AS DOUBLE) * CAST(coalesce(rel, 0) AS DOUBLE) AS s, CASE WHEN field_path = 'current_company' THEN {_folded("value_text")} WHEN field_path IN ('emails', 'phones') THEN {_stripped("value_text")} END AS part,
    CASE WHEN field_path = 'location' THEN coalesce(len(list_filter(json_extract_string({_stripped("value_text")}, '$.*'), lambda x: x IS NOT NULL AND x <> '')), 0) ELSE 0 END AS complete
  FROM evidence e JOIN c ON c.record_id = e.record_id LEFT JOIN up ON up.record_id = e.record_id LEFT JOIN t ON t.st = regexp_replace(lower(trim(source_type)), '[\s_-]+', '_', 'g') LEFT JOIN r ON r.mf = split_part(method, ':', 1)
  WHERE lower({_stripped("value_text")}) NOT IN ('', 'n/a', '-', '—', 'none', 'null', 'unknown')),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, field_path, part ORDER BY complete DESC, trust DESC, rel DESC, upd DESC, source_id, record_id, order_index, value, method) AS k FROM w),
win AS (SELECT * FROM k WHERE k = 1),
sup AS (SELECT cluster_id, field_path, coalesce(part, value) AS value, 1 - product(1 - s) AS agreement, sum(s) AS support FROM
  (SELECT cluster_id, field_path, coalesce(part, value) AS part, coalesce(part, value) AS value, source_id, max(s) AS s FROM w GROUP BY ALL) GROUP BY ALL),
sums AS (SELECT cluster_id, sum(support) AS total FROM sup WHERE field_path = 'full_name' GROUP BY cluster_id),
one AS (SELECT cluster_id, max(value) FILTER (WHERE field_path = 'full_name') AS full_name, max(value) FILTER (WHERE field_path = 'headline') AS headline, max(value) FILTER (WHERE field_path = 'location') AS place,
    max(TRY_CAST(value AS DOUBLE)) FILTER (WHERE field_path = 'years_experience') AS years FROM win WHERE field_path IN ('full_name', 'headline', 'location', 'years_experience') GROUP BY cluster_id),
lists AS (SELECT cluster_id, string_agg(value, '|' ORDER BY round(agreement, 6) DESC, value) FILTER (WHERE field_path = 'emails') AS emails, string_agg(value, '|' ORDER BY round(agreement, 6) DESC, value) FILTER (WHERE field_path = 'phones') AS phones,
    max(agreement) FILTER (WHERE field_path = 'emails') AS ce, max(agreement) FILTER (WHERE field_path = 'phones') AS cp, max(agreement) FILTER (WHERE field_path = 'current_company') AS cx FROM sup GROUP BY cluster_id),
jobs AS (SELECT cluster_id, string_agg(value, '|' ORDER BY value) AS companies FROM win WHERE field_path = 'current_company' GROUP BY cluster_id),
nc AS (SELECT w.cluster_id, agreement * support / total AS cn FROM win w JOIN sup ON sup.cluster_id = w.cluster_id AND sup.field_path = 'full_name' AND sup.value = w.value JOIN sums ON sums.cluster_id = w.cluster_id WHERE w.field_path = 'full_name'),
mk AS (SELECT cluster_id, min(CASE WHEN regexp_replace(lower(value), '^[^@]*@', '') IN ('gmail.com', 'googlemail.com') THEN replace(split_part(split_part(lower(value), '@', 1), '+', 1), '.', '') || '@gmail.com'
    ELSE split_part(split_part(lower(value), '@', 1), '+', 1) || '@' || regexp_replace(lower(value), '^[^@]*@', '') END) FILTER (WHERE field_path = 'emails') AS mail, min(value) FILTER (WHERE field_path = 'phones') AS phone,
    first(value ORDER BY value || chr(34)) FILTER (WHERE field_path = 'current_company') AS company FROM w GROUP BY cluster_id)
"""
MERGED_FIELDS = f"""
WITH {_MERGE}
SELECT cluster_id, substr(sha256(coalesce('email:' || mail, 'phone:' || phone, 'name+company:' || {_folded("full_name")} || '|' || {_folded("coalesce(company, '')")}, 'record:' || cluster_id)), 1, 16) AS candidate_id,
  full_name, headline, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, json_extract_string(place, '$.city') AS city, json_extract_string(place, '$.region') AS region, json_extract_string(place, '$.country') AS country,
  coalesce(companies, '') AS companies, years AS years_experience, round(round(coalesce(cn, 0), 6) + 2e-6, 3) AS c_full_name, round(round(coalesce(ce, 0), 6) + 2e-6, 3) AS c_emails,
  round(round(coalesce(cp, 0), 6) + 2e-6, 3) AS c_phones, round(round(coalesce(cx, 0), 6) + 2e-6, 3) AS c_experience
FROM (SELECT DISTINCT cluster_id FROM c) LEFT JOIN one USING (cluster_id) LEFT JOIN lists USING (cluster_id) LEFT JOIN jobs USING (cluster_id) LEFT JOIN nc USING (cluster_id) LEFT JOIN mk USING (cluster_id)
"""


def merged_post_spans(spark: SparkSession, d: str) -> DataFrame:
    """Dated posts of a person at a company as one entry where they overlap, by the merge operator."""
    month = lambda y, m: F.array(F.col(y), F.when(F.col(m).between(1, 12), F.col(m)))
    p = table(spark, d, "linkedin_positions").withColumns({"co": value_or_null(F.col("companyname")), "end": F.when(F.col("end_year").isNotNull(), month("end_year", "end_month"))})
    p = p.withColumn("cur", F.coalesce("iscurrent", F.lit(False)) & F.col("end").isNull()).where("record_id IS NOT NULL AND co IS NOT NULL AND start_year IS NOT NULL AND (cur OR end IS NOT NULL)")
    first = F.col("start_year") * 12 + F.when(F.col("start_month").between(1, 12), F.col("start_month")).otherwise(1) - 1
    last = F.when(F.col("cur"), F.lit(_NOW)).otherwise(F.col("end_year") * 12 + F.when(F.col("end_month").between(1, 12), F.col("end_month")).otherwise(12) - 1)
    p = p.where(first <= last)
    value = F.to_json(F.struct(F.col("co").alias("company"), F.col("end"), F.col("cur").alias("is_current"), month("start_year", "start_month").alias("start"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("title")), {"ignoreNullFields": "false"})
    atoms = p.select(
        F.col("record_id").alias("source_id"), F.lit("linkedin_json").alias("source_type"), "record_id", F.col("record_id").alias("cluster_id"), F.lit(None).cast("string").alias("updated_at"), F.lit("experience").alias("field_path"),
        value.alias("value"), F.lit("direct_field").alias("method"), F.coalesce("pos", F.lit(0)).alias("order_index"),
    )
    posts = merge.merged_posts(merge.with_strength(atoms), NOW)
    return posts.select(F.col("cluster_id").alias("record_id"), unaccent_col(F.col("company")).alias("company"), F.coalesce("s", F.lit(-1)).alias("s"), F.coalesce("e", F.lit(-1)).alias("e"), F.coalesce("reason", F.lit("")).alias("reason"))


MERGED_POST_SPANS = f"""
WITH p AS (SELECT record_id, {_folded("companyname")} AS company, start_year * 12 + CASE WHEN start_month BETWEEN 1 AND 12 THEN start_month ELSE 1 END - 1 AS s, start_month BETWEEN 1 AND 12 AS sk, end_month BETWEEN 1 AND 12 AS ek,
    coalesce(iscurrent, false) AND end_year IS NULL AS cur, CASE WHEN end_year IS NOT NULL THEN end_year * 12 + CASE WHEN end_month BETWEEN 1 AND 12 THEN end_month ELSE 12 END - 1 WHEN iscurrent THEN {_NOW} END AS e
  FROM linkedin_positions WHERE record_id IS NOT NULL AND start_year IS NOT NULL AND lower({_stripped("companyname")}) NOT IN ('', 'n/a', '-', '—', 'none', 'null', 'unknown')),
v AS (SELECT *, max(e) OVER (PARTITION BY record_id, company ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT record_id, company, s, e, bool_or(sk) AS sk, bool_or(ek) AS ek, bool_or(cur) AS cur FROM p WHERE e IS NOT NULL AND s <= e GROUP BY ALL)),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, company ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM v),
m AS (SELECT record_id, company, coalesce(min(s) FILTER (WHERE sk), min(s)) AS s, CASE WHEN bool_or(cur) THEN {_NOW} ELSE coalesce(max(e) FILTER (WHERE ek), max(e)) END AS e FROM i GROUP BY record_id, company, g),
o AS (SELECT *, CASE WHEN s > {_NOW} THEN 'future_dated_range' WHEN e < s THEN 'inverted_date_range' WHEN e > {_NOW} THEN 'future_end_clamped' ELSE '' END AS reason FROM m)
SELECT record_id, company, CAST(CASE WHEN reason IN ('', 'future_end_clamped') THEN s ELSE -1 END AS INT) AS s, CAST(CASE WHEN reason = '' THEN e WHEN reason = 'future_end_clamped' THEN {_NOW} ELSE -1 END AS INT) AS e, reason FROM o
"""


def projection_errors(spark: SparkSession, d: str) -> DataFrame:
    """What a query that forbids missing values reports, by record and field."""
    v = lambda c: value_or_null(F.col(c))
    profiles = table(spark, d, "t1_ats").select(
        F.col("record_id").alias("candidate_id"), v("candidatename").alias("full_name"), F.filter(F.array(v("emailaddress"), v("email_id")), lambda e: e.isNotNull()).alias("emails"),
        F.struct(v("city").alias("city"), v("region").alias("region"), v("country").alias("country")).alias("location"),
    )
    q = compile_query({"on_missing": "error", "fields": [{"path": "id", "from": "candidate_id", "type": "string", "required": True}, {"path": "who.name", "from": "full_name", "type": "string"}, {"path": "who.mail", "from": "emails[0]", "type": "string", "required": True}, {"path": "town", "from": "location.city", "type": "string"}]})
    return project(profiles, q)[1]


def _absent(c: str) -> str:
    return f"coalesce(lower({_stripped(c)}), '') IN ('', 'n/a', '-', '—', 'none', 'null', 'unknown')"


PROJECTION_ERRORS = f"""
SELECT record_id AS candidate_id, 'who.name' AS field, 'missing' AS problem FROM t1_ats WHERE {_absent("candidatename")}
UNION ALL SELECT record_id, 'who.mail', 'required_missing' FROM t1_ats WHERE {_absent("emailaddress")} AND {_absent("email_id")}
UNION ALL SELECT record_id, 'town', 'missing' FROM t1_ats WHERE {_absent("city")}
"""

ALL = {
    "parse_roster": (parse_roster, PARSE_ROSTER), "parse_ats": (parse_ats, PARSE_ATS), "parse_linkedin": (parse_linkedin, PARSE_LINKEDIN), "parse_notes": (parse_notes, PARSE_NOTES),
    "hyphen_heal": (hyphen_heal, HYPHEN_HEAL), "as_of": (as_of, AS_OF), "phone_outcomes": (phone_outcomes, PHONE_OUTCOMES), "resolved_clusters": (resolved_clusters, RESOLVED_CLUSTERS),
    "resolved_refusals": (resolved_refusals, RESOLVED_REFUSALS), "merged_fields": (merged_fields, MERGED_FIELDS), "merged_post_spans": (merged_post_spans, MERGED_POST_SPANS), "projection_errors": (projection_errors, PROJECTION_ERRORS),
}
