"""Queries of the core operators over a data folder, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrobora import operator_queries
from corrobora.functions import contacts, dictionaries, partial_dates
from corrobora.functions.skills import SkillScanner, country_code_col
from corrobora.functions.text import null_marker_col, unaccent_col
from corrobora.functions.values import value_or_null
from corrobora.operators import confidence as C
from corrobora.operators import identity, merge
from corrobora.operators.components import min_label_components
from corrobora.operators.layout import spread
from corrobora.operators.packed import learn_lattice, unpack
from corrobora.operators.periods import continuous_periods, merge_periods, post_months, posts_of
from corrobora.plans.config import DEFAULT, RECRUITER_VIEW, compile_query
from corrobora.plans.projection import project
from corrobora.session import cut, table
from corrobora.sources.tables import ats_atoms, evidence_atoms, roster_atoms
from corrobora.streaming.incremental import event_windows

Query = Callable[[SparkSession, str], DataFrame]
#: Rows of an alias table that are sent to every executor; a longer one raises an error.
MOST_ALIASES = 100_000


def _aliases(entries: DataFrame, entry: str) -> dict[str, str]:
    rows = entries.select("alias", entry).limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"an alias table has more than {MOST_ALIASES} rows")
    return {r[0]: r[1] for r in rows}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return continuous_periods(table(spark, d, "linkedin_positions"), table(spark, d, "ats_work_history"))


P2_SQL = r"""
WITH h AS (
  SELECT record_id, lower(trim(from_raw)) AS f, lower(trim(to_raw)) AS t FROM ats_work_history),
m AS (SELECT * FROM (VALUES ('jan',1),('feb',2),('mar',3),('apr',4),('may',5),('jun',6),('jul',7),('aug',8),('sep',9),('oct',10),('nov',11),('dec',12)) v(name, num)),
raw AS (SELECT DISTINCT f AS x FROM h UNION SELECT DISTINCT t FROM h),
parsed AS (
  SELECT x,
    TRY_CAST(regexp_extract(x, '(\d{4})', 1) AS INT) AS y_any,
    CASE WHEN regexp_matches(x, '^\d{4}[-./]\d{1,2}') THEN TRY_CAST(regexp_extract(x, '^\d{4}[-./](\d{1,2})', 1) AS INT)
         WHEN regexp_matches(x, '^\d{1,2}[-./]\d{4}$') THEN TRY_CAST(regexp_extract(x, '^(\d{1,2})', 1) AS INT)
         ELSE (SELECT num FROM m WHERE m.name = substr(regexp_extract(x, '([a-z]{3,})', 1), 1, 3)) END AS mo
  FROM raw WHERE x IS NOT NULL),
posts AS (
  SELECT record_id, start_year AS sy, start_month AS sm, end_year AS ey, end_month AS em, coalesce(iscurrent, false) AS cur FROM linkedin_positions
  UNION ALL
  SELECT record_id, a.y_any, a.mo, b.y_any, b.mo, coalesce(t IN ('present','current','now','ongoing'), false)
  FROM h LEFT JOIN parsed a ON h.f = a.x LEFT JOIN parsed b ON h.t = b.x),
n AS (
  SELECT record_id, sy * 12 + CASE WHEN sm BETWEEN 1 AND 12 THEN sm ELSE 1 END - 1 AS s,
    CASE WHEN ey IS NOT NULL THEN ey * 12 + CASE WHEN em BETWEEN 1 AND 12 THEN em ELSE 12 END - 1 WHEN cur THEN 2026 * 12 + 7 END AS e FROM posts),
k AS (SELECT DISTINCT record_id, s, least(e, 2026 * 12 + 7) AS e FROM n WHERE record_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND e >= s AND s <= 2026 * 12 + 7),
w AS (SELECT *, max(e) OVER (PARTITION BY record_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w),
p AS (SELECT record_id, min(s) AS s, max(e) AS e FROM i GROUP BY record_id, g),
q AS (SELECT *, lead(s) OVER (PARTITION BY record_id ORDER BY s) AS nx FROM p)
SELECT record_id, 'period' AS kind, CAST(s // 12 * 100 + s % 12 + 1 AS INT) AS first_month, CAST(e // 12 * 100 + e % 12 + 1 AS INT) AS last_month FROM q
UNION ALL
SELECT record_id, 'gap', CAST((e + 1) // 12 * 100 + (e + 1) % 12 + 1 AS INT), CAST((nx - 1) // 12 * 100 + (nx - 1) % 12 + 1 AS INT) FROM q WHERE nx IS NOT NULL
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "t1_ats").select("record_id", "skills").unionByName(table(spark, d, "ats").select("record_id", "skills"))
    return unpack(rows, "skills", ["record_id"], "skill", learn_lattice(rows, "skills"))


#: SQL condition of a text that holds a value.
_HAS = "lower(trim({0}, chr(9) || ' ')) NOT IN ('','n/a','-','—','none','null','unknown')"
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def evidence_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Roster columns as one row per value."""
    r = table(spark, d, "t1_roster").select("record_id", "name", "email", "phone", "current_company", "title")
    long = r.unpivot("record_id", ["name", "email", "phone", "current_company", "title"], "field_path", "raw")
    return long.select("record_id", "field_path", value_or_null(F.col("raw")).alias("value")).where(F.col("value").isNotNull())


EVIDENCE_UNPIVOT = (
    "WITH l AS ("
    + " UNION ALL ".join(f"SELECT record_id, '{c}' AS field_path, trim({c}, chr(9) || ' ') AS value FROM t1_roster WHERE {_HAS.format(c)}" for c in ("name", "email", "phone", "current_company", "title"))
    + ") SELECT * FROM l"
)


def _emails(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "t1_ats").select("record_id", F.explode(F.array("emailaddress", "email_id")).alias("cell")).where(F.col("cell").isNotNull())
    return e.select("record_id", F.explode(contacts.email_candidates(F.col("cell"))).alias("raw"))


def email_extract(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in the cells of t1_ats, normalised."""
    return _emails(spark, d).select("record_id", contacts.email_normalized(F.col("raw")).alias("email")).where(F.col("email").isNotNull())


_EMAILS_SQL = f"""
e AS (SELECT record_id, lower(unnest(regexp_extract_all(cell, '{_EMAIL}'))) AS raw FROM (SELECT record_id, unnest([emailaddress, email_id]) AS cell FROM t1_ats) WHERE cell IS NOT NULL),
m AS (SELECT record_id, trim(raw, ' .,;<>()[]"''') AS email FROM e)
"""
EMAIL_EXTRACT = f"WITH {_EMAILS_SQL} SELECT record_id, email FROM m WHERE regexp_full_match(email, '{_EMAIL}')"


def email_match_key(spark: SparkSession, d: str) -> DataFrame:
    """Matching keys, plus tags and gmail dots aside; every fifth address is read as gmail by a made-up domain to reach that branch."""
    e = email_extract(spark, d)
    gmail = F.regexp_replace("email", "@inkpost[.]example$", "@googlemail.com")
    return e.select("record_id", "email", contacts.email_match_key(gmail).alias("match_key"))


EMAIL_MATCH_KEY = f"""
WITH {_EMAILS_SQL}, g AS (SELECT record_id, email, regexp_replace(email, '@inkpost[.]example$', '@googlemail.com') AS x FROM m WHERE regexp_full_match(email, '{_EMAIL}'))
SELECT record_id, email, CASE WHEN split_part(x, '@', 2) IN ('gmail.com', 'googlemail.com')
  THEN replace(split_part(split_part(x, '@', 1), '+', 1), '.', '') || '@gmail.com' ELSE split_part(split_part(x, '@', 1), '+', 1) || '@' || split_part(x, '@', 2) END AS match_key FROM g
"""


def phone_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts of phone cells with nine digits or more, extensions aside."""
    r = table(spark, d, "t1_roster").select("record_id", F.explode(contacts.split_phones(F.col("phone"))).alias("part"))
    n = r.select("record_id", "part", contacts.strip_extension(F.col("part")).alias("number"))
    return n.withColumn("digits", F.length(F.regexp_replace("number", "[^0-9]", ""))).where("digits >= 9")


PHONE_CANDIDATES = r"""
WITH p AS (SELECT record_id, trim(unnest(regexp_split_to_array(phone, '[/;,]|\band\b'))) AS part FROM t1_roster WHERE phone IS NOT NULL),
n AS (SELECT record_id, part, regexp_replace(part, '(?i)\s*(?:ext\.?|extension|x)\s*\d+\s*$', '') AS number FROM p WHERE regexp_matches(part, '[0-9]'))
SELECT record_id, part, number, CAST(length(regexp_replace(number, '[^0-9]', '', 'g')) AS INT) AS digits FROM n WHERE length(regexp_replace(number, '[^0-9]', '', 'g')) >= 9
"""


def url_classify(spark: SparkSession, d: str) -> DataFrame:
    """Buckets and keys of links made from record ids, at an unknown host and at the two known ones."""
    u = table(spark, d, "t1_ats").select(F.concat(F.lit("https://profiles.example/"), "record_id").alias("url"))
    login = F.regexp_extract("url", "([0-9]+)$", 1)
    forms = F.explode(F.array(F.col("url"), F.concat(F.lit("www.GitHub.com/"), login, F.lit("/?tab=repos.")), F.concat(F.lit("HTTPS://linkedin.com/in/"), login, F.lit("#top,")))).alias("url")
    f = u.select(forms)
    return f.select("url", contacts.url_bucket(F.col("url")).alias("bucket"), contacts.url_clean(F.col("url")).alias("clean"), contacts.url_match_key(F.col("url")).alias("match_key"))


URL_CLASSIFY = r"""
WITH l AS (SELECT 'https://profiles.example/' || record_id AS url, regexp_extract(record_id, '([0-9]+)$', 1) AS login FROM t1_ats),
f AS (SELECT unnest([url, 'www.GitHub.com/' || login || '/?tab=repos.', 'HTTPS://linkedin.com/in/' || login || '#top,']) AS url FROM l),
c AS (SELECT url, CASE WHEN lower(regexp_replace(url, '[.,;:]+$', '')) LIKE 'http%' THEN regexp_replace(url, '[.,;:]+$', '') ELSE 'https://' || regexp_replace(url, '[.,;:]+$', '') END AS clean FROM f),
h AS (SELECT *, regexp_replace(regexp_extract(lower(clean), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') AS host FROM c)
SELECT url, CASE WHEN host LIKE '%linkedin.com' THEN 'linkedin' WHEN host LIKE '%github.com' THEN 'github' ELSE 'other' END AS bucket, clean,
  regexp_replace(host || regexp_extract(lower(clean), '^[a-z]+://[^/?#]*([^?#;]*)', 1), '/+$', '') AS match_key FROM h
"""


def skill_scan(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary skills in whole documents, each once, by word borders."""
    aliases = _aliases(table(spark, d, "skill_aliases"), "canonical")
    scanner = SkillScanner(aliases)

    @F.pandas_udf("array<string>")
    def found(s: pd.Series) -> pd.Series:
        return pd.Series([list(scanner.find(t)) if t else [] for t in s], dtype=object)

    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(found("text")).alias("skill"))


SKILL_SCAN = r"""
WITH a AS (SELECT '(^|[^a-z0-9+#])' || regexp_escape(alias) || '($|[^a-z0-9+#])' AS p, alias, canonical FROM skill_aliases WHERE alias NOT IN ('go', 'rest', 'spring', 'express', 'swift', 'js')),
t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, canonical AS skill FROM t JOIN a ON contains(t.t, a.alias) AND regexp_matches(t.t, a.p)
"""


def null_markers(spark: SparkSession, d: str) -> DataFrame:
    """values of t1_ats that stand for none, by column."""
    a = table(spark, d, "t1_ats").select("record_id", "currentemployer", "designation", "city", "region", "country", "phonenumber")
    long = a.unpivot("record_id", a.columns[1:], "field", "raw").where("raw IS NOT NULL")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(null_marker_col(F.col("raw"))).alias("n_null"))


NULL_MARKERS = """
WITH l AS (UNPIVOT (SELECT currentemployer, designation, city, region, country, phonenumber FROM t1_ats) ON COLUMNS(*) INTO NAME field VALUE raw)
SELECT field, count(*) AS n, count(*) FILTER (WHERE trim(lower(trim(raw, chr(9) || ' ')), ' .') IN ('', '-', '--', '—', '–', 'n/a', 'n.a', 'na', 'none', 'null', 'nil', 'tbd', 'unknown', '?')) AS n_null FROM l GROUP BY field
"""


def block_links(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the smallest record that shares its e-mail key, so a key gives one row per record, not all pairs."""
    e = _emails(spark, d).select("record_id", contacts.email_match_key(contacts.email_normalized(F.col("raw"))).alias("key")).where("key IS NOT NULL").distinct()
    base = e.groupBy("key").agg(F.min("record_id").alias("base"), F.count(F.lit(1)).alias("n_records")).where("n_records > 1")
    return e.join(base, "key").where("record_id <> base").select("key", "base", F.col("record_id").alias("other"), "n_records")


_KEYS_SQL = f"""
{_EMAILS_SQL}, k AS (SELECT DISTINCT record_id, CASE WHEN split_part(email, '@', 2) IN ('gmail.com', 'googlemail.com')
  THEN replace(split_part(split_part(email, '@', 1), '+', 1), '.', '') || '@gmail.com' ELSE split_part(split_part(email, '@', 1), '+', 1) || '@' || split_part(email, '@', 2) END AS key
  FROM m WHERE regexp_full_match(email, '{_EMAIL}'))
"""
BLOCK_LINKS = f"""
WITH {_KEYS_SQL}, b AS (SELECT key, min(record_id) AS base, count(*) AS n_records FROM k GROUP BY key HAVING count(*) > 1)
SELECT key, base, record_id AS other, n_records FROM k JOIN b USING (key) WHERE record_id <> base
"""


def multi_identity(spark: SparkSession, d: str) -> DataFrame:
    """Free-text records with two or more e-mail keys or phones, which speak of several people."""
    atoms = evidence_atoms(table(spark, d, "evidence"), table(spark, d, "source_records"))
    return identity.record_keys(atoms)[1].select("record_id")


MULTI_IDENTITY = f"""
WITH e AS (SELECT record_id, field_path, trim(value_text) AS v, regexp_replace(lower(trim(source_type)), '[\\s_-]+', '_', 'g') AS st FROM evidence WHERE {_HAS.format("value_text")}),
k AS (SELECT DISTINCT record_id, field_path, CASE WHEN field_path = 'emails' THEN split_part(split_part(lower(v), '@', 1), '+', 1) || '@' || split_part(lower(v), '@', 2) ELSE v END AS key
  FROM e WHERE st IN ('notes_txt', 'resume') AND field_path IN ('emails', 'phones'))
SELECT DISTINCT record_id FROM (SELECT record_id, field_path FROM k GROUP BY ALL HAVING count(*) >= 2)
"""


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """J5 (i): components of the graph of evidence records and their e-mail addresses and phones."""
    e = table(spark, d, "evidence").where(F.col("field_path").isin("emails", "phones")).select("record_id", value_or_null(F.col("value_text")).alias("hub")).where("hub IS NOT NULL")
    return min_label_components(e, "record_id", "hub")


CONNECTED_COMPONENTS = f"""
WITH RECURSIVE e AS (SELECT DISTINCT record_id, trim(value_text) AS hub FROM evidence WHERE field_path IN ('emails', 'phones') AND {_HAS.format("value_text")}),
g AS (SELECT DISTINCT a.record_id AS a, b.record_id AS b FROM e a JOIN e b USING (hub)),
reach(id, c) AS (SELECT record_id, record_id FROM e UNION SELECT g.b, reach.c FROM reach JOIN g ON g.a = reach.id WHERE reach.c < g.b)
SELECT id AS record_id, min(c) AS component FROM reach GROUP BY id
"""


def guarded_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Records of t1_ats and t1_roster in clusters under the contradiction guard."""
    who = identity.resolve(_people_atoms(spark, d))
    return who.clusters.select("cluster_id", F.size("record_ids").alias("n_records"), F.array_join("match_keys_used", ",").alias("keys"), F.array_join("flags", ",").alias("flags"))


def union_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Unions refused because names contradict, and their keys."""
    who = identity.resolve(_people_atoms(spark, d))
    return who.refusals.select(F.array_join("records", " ").alias("records"), "key", "reason")


def _people_atoms(spark: SparkSession, d: str) -> DataFrame:
    aliases = _aliases(table(spark, d, "skill_aliases"), "canonical")
    return cut(ats_atoms(table(spark, d, "t1_ats"), aliases).unionByName(roster_atoms(table(spark, d, "t1_roster"))))


def name_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether the names of records with one e-mail key agree with that of the key's smallest record."""
    tokens = F.filter(F.split(unaccent_col(F.col("candidatename")), r"(?U)[^\w]+"), lambda t: t != "")
    n = table(spark, d, "t1_ats").select("record_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))
    links = block_links(spark, d).select("key", "base", "other")
    at = links.join(n.select(F.col("record_id").alias("base"), F.col("t").alias("a")), "base").join(n.select(F.col("record_id").alias("other"), F.col("t").alias("b")), "other")
    return at.select("key", "base", "other", identity.names_compatible_col(F.col("a"), F.col("b")).alias("compatible"))


NAME_COMPATIBILITY = f"""
WITH {_KEYS_SQL}, b AS (SELECT key, min(record_id) AS base FROM k GROUP BY key HAVING count(*) > 1),
n AS (SELECT record_id, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(candidatename, ''))), '[^a-z0-9_]+'), lambda t: t <> '') AS t FROM t1_ats),
p AS (SELECT key, base, k.record_id AS other, x.t AS ta, y.t AS tb FROM k JOIN b USING (key) JOIN n x ON x.record_id = base JOIN n y ON y.record_id = k.record_id WHERE k.record_id <> base)
SELECT key, base, other, len(ta) = 0 OR len(tb) = 0 OR len(list_filter(ta, lambda x: len(list_filter(tb, lambda y: x = y OR (length(x) = 1 AND starts_with(y, x)) OR (length(y) = 1 AND starts_with(x, y)))) > 0)) > 0 AS compatible FROM p
"""


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    """evidence with cluster, trust, reliability and strength by the default scores."""
    records = table(spark, d, "source_records").groupBy("record_id", "cluster_id").agg(F.max(value_or_null(F.col("updated_at"))).alias("updated_at"))
    e = table(spark, d, "evidence").withColumn("value", value_or_null(F.col("value_text"))).where("value IS NOT NULL")
    e = e.withColumn("source_type", F.regexp_replace(F.lower(F.trim("source_type")), r"[\s_-]+", "_")).join(records, "record_id")
    return merge.with_strength(e.select("cluster_id", "field_path", "value", "source_id", "source_type", "record_id", "order_index", "method", "updated_at"))


_WEIGHED_SQL = f"""
t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in dictionaries.SOURCE_TRUST.items())}) x(st, trust)),
r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in dictionaries.METHOD_RELIABILITY.items())}) x(mf, rel)),
c AS (SELECT record_id, cluster_id, max(CASE WHEN {_HAS.format("updated_at")} THEN trim(updated_at) END) AS upd FROM source_records GROUP BY ALL),
w AS (SELECT c.cluster_id, field_path, trim(value_text) AS value, source_id, e.record_id, order_index, method, coalesce(upd, '') AS upd, CAST(coalesce(trust, 0) AS DOUBLE) AS trust, CAST(coalesce(rel, 0) AS DOUBLE) AS rel, CAST(coalesce(trust, 0) AS DOUBLE) * CAST(coalesce(rel, 0) AS DOUBLE) AS s
  FROM evidence e JOIN c ON c.record_id = e.record_id LEFT JOIN t ON t.st = regexp_replace(lower(trim(source_type)), '[\\s_-]+', '_', 'g') LEFT JOIN r ON r.mf = split_part(method, ':', 1)
  WHERE {_HAS.format("value_text")}),
v AS (SELECT cluster_id, field_path, value, 1 - product(1 - s) AS agreement, sum(s) AS support FROM (SELECT cluster_id, field_path, value, source_id, max(s) AS s FROM w GROUP BY ALL) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, field_path ORDER BY trust DESC, rel DESC, upd DESC, source_id, record_id, order_index, value, method) AS k FROM w)
"""


def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    """A2, A3, A5: confidence of every value of a cluster's field, corroboration counted once per source."""
    v = C.value_support(_weighed(spark, d), ["cluster_id", "field_path"], "value")
    return v.select("cluster_id", "field_path", "value", F.round(F.col("agreement") + 1e-9, 4).alias("confidence"))


NOISY_OR = f"WITH {_WEIGHED_SQL} SELECT cluster_id, field_path, value, round(agreement + 1e-9, 4) AS confidence FROM v"


def survivorship(spark: SparkSession, d: str) -> DataFrame:
    """The atom that ranks first in each field by trust, method, recency as text, source, record and position."""
    a = _weighed(spark, d)
    best = a.groupBy("cluster_id", "field_path").agg(F.min("pref").alias("p"))
    return best.select("cluster_id", "field_path", F.col("p.v").alias("value"), F.col("p.record_id").alias("record_id"), F.col("p.order_index").alias("order_index"))


SURVIVORSHIP = f"WITH {_WEIGHED_SQL} SELECT cluster_id, field_path, value, record_id, order_index FROM k WHERE k = 1"


def scalar_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Winner of each scalar field, its agreement times its share of all support, and how many other values there are."""
    v = merge.value_table(_weighed(spark, d).where(F.col("field_path").isin("full_name", "headline")), ["cluster_id", "field_path"])
    w = merge.winners(v)
    return w.select("cluster_id", "field_path", "value", F.round(F.col("confidence") + 2e-6, 3).alias("confidence"), F.array_join("alternatives", "|").alias("alternatives"))


SCALAR_CONFIDENCE = f"""
WITH {_WEIGHED_SQL}, tot AS (SELECT cluster_id, field_path, sum(support) AS total, list_sort(list(DISTINCT value)) AS vs FROM v GROUP BY ALL)
SELECT cluster_id, field_path, k.value, round(round(agreement * support / total, 6) + 2e-6, 3) AS confidence, coalesce(array_to_string(list_filter(vs, lambda x: x <> k.value), '|'), '') AS alternatives
FROM k JOIN v USING (cluster_id, field_path, value) JOIN tot USING (cluster_id, field_path) WHERE k.k = 1 AND field_path IN ('full_name', 'headline')
"""


def atomic_location(spark: SparkSession, d: str) -> DataFrame:
    """Locations compare by their known parts first and survive whole."""
    v = merge.value_table(_weighed(spark, d).where("field_path = 'location'"), ["cluster_id", "field_path"])
    return merge.winners(v).select("cluster_id", "value")


ATOMIC_LOCATION = f"""
WITH {_WEIGHED_SQL}, cc AS (SELECT *, coalesce(len(list_filter(json_extract_string(value, '$.*'), lambda x: x IS NOT NULL AND x <> '')), 0) AS complete FROM w WHERE field_path = 'location')
SELECT cluster_id, value FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY complete DESC, trust DESC, rel DESC, upd DESC, source_id, record_id, order_index, value, method) AS n FROM cc) WHERE n = 1
"""


def set_ranking(spark: SparkSession, d: str) -> DataFrame:
    """E-mails of a cluster by confidence, then value, with their positions."""
    v = C.value_support(_weighed(spark, d).where("field_path = 'emails'"), ["cluster_id"], "value").withColumn("c", F.round(F.col("agreement") + 1e-9, 4))
    a = v.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("down"), "value"))).alias("x"))
    return a.select("cluster_id", F.posexplode("x").alias("pos", "x")).select("cluster_id", "pos", "x.value", (-F.col("x.down")).alias("confidence"))


SET_RANKING = f"""
WITH {_WEIGHED_SQL}, cc AS (SELECT cluster_id, value, round(agreement + 1e-9, 4) AS confidence FROM v WHERE field_path = 'emails')
SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, value) - 1 AS INT) AS pos, value, confidence FROM cc
"""


def overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of the best-attested value of each field; fields without a value count 0."""
    v = C.value_support(_weighed(spark, d), ["cluster_id", "field_path"], "value").groupBy("cluster_id", "field_path").agg(F.round(F.max("agreement") + 1e-9, 4).alias("c"))
    m = v.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("field_path", "c"))).alias("m"))
    return m.select("cluster_id", F.round(C.overall(F.col("m")), 4).alias("overall"))


OVERALL_CONFIDENCE = f"""
WITH {_WEIGHED_SQL}, f AS (SELECT cluster_id, field_path, round(max(agreement) + 1e-9, 4) AS c FROM v GROUP BY ALL),
g AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in dictionaries.FIELD_WEIGHTS.items())}) x(field_path, wt))
SELECT cluster_id, round(coalesce(sum(wt * c), 0) / 17.0, 4) AS overall FROM f LEFT JOIN g USING (field_path) GROUP BY cluster_id
"""


def same_job_groups(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping posts at one company as one, over both tables of posts; islands equal the closure of pairwise overlap for valid ranges."""
    p = posts_of(table(spark, d, "linkedin_positions"), table(spark, d, "ats_work_history"), company=True)
    p = p.withColumn("co", value_or_null(F.col("company"))).where("co IS NOT NULL AND record_id IS NOT NULL")
    p = p.withColumn("record_id", F.concat_ws("|", "record_id", unaccent_col(F.col("co"))))
    # Touching ranges are two posts here, so ends are pulled in by a month's half: months are doubled.
    m = post_months(p, 2026 * 12 + 7).select("record_id", (F.col("s") * 2).alias("s"), (F.col("e") * 2).alias("e"))
    g = merge_periods(m)
    return g.select(F.split_part("record_id", F.lit("|"), F.lit(1)).alias("record_id"), F.split_part("record_id", F.lit("|"), F.lit(2)).alias("company"), (F.col("s") / 2).cast("int").alias("s"), (F.col("e") / 2).cast("int").alias("e"))


#: The posts of both tables with their company, as P2_SQL reads them.
_POSTS_SQL = (
    P2_SQL.partition(",\nn AS (")[0].replace("SELECT record_id, lower(trim(from_raw))", "SELECT record_id, org, lower(trim(from_raw))")
    .replace("SELECT record_id, start_year AS sy", "SELECT record_id, companyname AS co, start_year AS sy").replace("SELECT record_id, a.y_any", "SELECT record_id, org, a.y_any")
)
SAME_JOB_GROUPS = f"""
{_POSTS_SQL},
n AS (SELECT record_id, lower(strip_accents(trim(co))) AS company, sy * 12 + CASE WHEN sm BETWEEN 1 AND 12 THEN sm ELSE 1 END - 1 AS s,
    CASE WHEN ey IS NOT NULL THEN ey * 12 + CASE WHEN em BETWEEN 1 AND 12 THEN em ELSE 12 END - 1 WHEN cur THEN 2026 * 12 + 7 END AS e FROM posts),
k AS (SELECT DISTINCT record_id, company, s, least(e, 2026 * 12 + 7) AS e FROM n WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s AND s <= 2026 * 12 + 7 AND record_id IS NOT NULL),
c AS (SELECT * FROM k WHERE company NOT IN ('','n/a','-','—','none','null','unknown')),
w AS (SELECT *, max(e) OVER (PARTITION BY record_id, company ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, company ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w)
SELECT record_id, company, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e FROM i GROUP BY record_id, company, g
"""


def years_experience(spark: SparkSession, d: str) -> DataFrame:
    """Years of the union of a record's months in both tables of posts, half up to one decimal."""
    posts = post_months(posts_of(table(spark, d, "linkedin_positions"), table(spark, d, "ats_work_history")), 2026 * 12 + 7)
    g = merge_periods(posts).groupBy("record_id").agg(F.sum(F.col("e") - F.col("s") + 1).alias("months"))
    return g.select("record_id", F.col("months").cast("bigint").alias("months"), F.round(F.col("months").cast("decimal(12,4)") / 12, 1).cast("double").alias("years"))


YEARS_EXPERIENCE = f"""
{P2_SQL.partition(",\np AS (")[0]}, p AS (SELECT record_id, max(e) - min(s) + 1 AS n FROM i GROUP BY record_id, g)
SELECT record_id, CAST(sum(n) AS BIGINT) AS months, CAST(round(CAST(sum(n) AS DECIMAL(12,4)) / CAST(12 AS DECIMAL(12,4)), 1) AS DOUBLE) AS years FROM p GROUP BY record_id
"""


def partial_date_parse(spark: SparkSession, d: str) -> DataFrame:
    """First date of each free text, its rendering and month bounds; ambiguous months stay unknown."""
    h = table(spark, d, "ats_work_history").select("from_raw").where("from_raw IS NOT NULL").distinct()
    p = h.select("from_raw", partial_dates.parse_col(F.col("from_raw")).alias("d")).where("d IS NOT NULL")
    y, m = F.col("d.y"), F.col("d.m")
    return p.select("from_raw", partial_dates.render_col(y, m).alias("month"), partial_dates.month_index_col(y, m, "start").alias("first"), partial_dates.month_index_col(y, m, "end").alias("last"))


PARTIAL_DATE_PARSE = r"""
WITH x AS (SELECT DISTINCT from_raw, lower(from_raw) AS f FROM ats_work_history WHERE from_raw IS NOT NULL),
n AS (SELECT * FROM (VALUES ('jan',1),('feb',2),('mar',3),('apr',4),('may',5),('jun',6),('jul',7),('aug',8),('sep',9),('oct',10),('nov',11),('dec',12)) v(name, num)),
p AS (SELECT from_raw, CAST(nullif(regexp_extract(f, '(\d{4})', 1), '') AS INT) AS y,
  CASE WHEN regexp_matches(f, '\d{4}[-/]\d{1,2}') THEN CAST(regexp_extract(f, '\d{4}[-/](\d{1,2})', 1) AS INT)
       WHEN regexp_matches(f, '\d{1,2}[-/]\d{4}') THEN CAST(regexp_extract(f, '(\d{1,2})[-/]\d{4}', 1) AS INT)
       WHEN regexp_matches(f, '[a-z]{3,}\.?,?\s+\d{4}') THEN (SELECT num FROM n WHERE name = regexp_extract(f, '([a-z]{3})[a-z]*\.?,?\s+\d{4}', 1)) END AS m FROM x),
q AS (SELECT from_raw, y, CASE WHEN m BETWEEN 1 AND 12 THEN m END AS m FROM p WHERE y IS NOT NULL)
SELECT from_raw, CASE WHEN m IS NULL THEN printf('%04d', y) ELSE printf('%04d-%02d', y, m) END AS month, CAST(y * 12 + coalesce(m, 1) - 1 AS INT) AS first, CAST(y * 12 + coalesce(m, 12) - 1 AS INT) AS last FROM q
"""


def country_alias(spark: SparkSession, d: str) -> DataFrame:
    """Countries by a dictionary, as a literal map inside the scan's stage."""
    aliases = _aliases(table(spark, d, "country_aliases"), "country_code")
    a = table(spark, d, "t1_ats").select("record_id", "country").where("country IS NOT NULL")
    return a.select("record_id", "country", country_code_col(F.col("country"), aliases).alias("code"))


COUNTRY_ALIAS = "SELECT record_id, country, country_code AS code FROM t1_ats LEFT JOIN country_aliases ON alias = trim(lower(trim(country, chr(9) || ' ')), ' .') WHERE country IS NOT NULL"


def contested_keys(spark: SparkSession, d: str) -> DataFrame:
    """E-mails seen in more than one cluster."""
    e = table(spark, d, "evidence").where("field_path = 'emails'").select("record_id", contacts.email_match_key(value_or_null(F.col("value_text"))).alias("key")).where("key IS NOT NULL")
    c = e.join(table(spark, d, "source_records").select("record_id", "cluster_id").distinct(), "record_id")
    return c.groupBy("key").agg(F.count_distinct("cluster_id").alias("n_clusters")).where("n_clusters > 1")


_SEEDS_SQL = f"""
e AS (SELECT record_id, lower(trim(value_text)) AS v FROM evidence WHERE field_path = 'emails' AND {_HAS.format("value_text")}),
k AS (SELECT DISTINCT cluster_id, split_part(split_part(v, '@', 1), '+', 1) || '@' || regexp_replace(v, '^[^@]*@', '') AS key FROM e JOIN source_records s USING (record_id)),
x AS (SELECT key, count(DISTINCT cluster_id) AS n_clusters FROM k GROUP BY key HAVING count(DISTINCT cluster_id) > 1)
"""
CONTESTED_KEYS = f"WITH {_SEEDS_SQL} SELECT key, n_clusters FROM x"


def candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Id of each cluster from its smallest e-mail key that no other cluster holds, else from the cluster."""
    e = table(spark, d, "evidence").where("field_path = 'emails'").select("record_id", contacts.email_match_key(value_or_null(F.col("value_text"))).alias("key")).where("key IS NOT NULL")
    members = table(spark, d, "source_records").select("record_id", "cluster_id").distinct()
    own = e.join(members, "record_id").join(contested_keys(spark, d), "key", "left_anti").groupBy("cluster_id").agg(F.min("key").alias("key"))
    c = members.select("cluster_id").distinct().join(own, "cluster_id", "left")
    seed = F.coalesce(F.concat(F.lit("email:"), "key"), F.concat(F.lit("record:"), "cluster_id"))
    return c.select("cluster_id", F.substring(F.sha2(seed, 256), 1, 16).alias("candidate_id"))


CANDIDATE_IDS = f"""
WITH {_SEEDS_SQL}, o AS (SELECT cluster_id, min(key) AS key FROM k WHERE key NOT IN (SELECT key FROM x) GROUP BY cluster_id)
SELECT cluster_id, substr(sha256(coalesce('email:' || key, 'record:' || cluster_id)), 1, 16) AS candidate_id FROM (SELECT DISTINCT cluster_id FROM source_records) LEFT JOIN o USING (cluster_id)
"""


def projection_on_missing(spark: SparkSession, d: str) -> DataFrame:
    """A query with a required field, an index path, a nested output and a normalizer, over rows in the canonical shape."""
    a = table(spark, d, "t1_ats")
    v = lambda c: value_or_null(F.col(c))
    profiles = a.select(
        F.col("record_id").alias("candidate_id"), v("candidatename").alias("full_name"), F.filter(F.array(v("emailaddress"), v("email_id")), lambda e: e.isNotNull()).alias("emails"),
        F.struct(v("city").alias("city"), v("region").alias("region"), v("country").alias("country")).alias("location"),
    )
    q = compile_query({
        "fields": [
            {"path": "id", "from": "candidate_id", "type": "string", "required": True}, {"path": "name", "from": "full_name", "type": "string", "normalize": "lower"},
            {"path": "primary", "from": "emails[0]", "type": "string", "required": True}, {"path": "second", "from": "emails[1]", "type": "string"}, {"path": "town", "from": "location.city", "type": "string"},
        ],
    })
    return project(profiles, q)[0].drop("candidate_key")


PROJECTION_ON_MISSING = f"""
WITH p AS (SELECT record_id AS id, {", ".join(f"CASE WHEN {_HAS.format(c)} THEN trim({c}, chr(9) || ' ') END AS {c}" for c in ("candidatename", "emailaddress", "email_id", "city"))} FROM t1_ats)
SELECT id, lower(candidatename) AS name, coalesce(emailaddress, email_id) AS "primary", CASE WHEN emailaddress IS NOT NULL THEN email_id END AS second, city AS town FROM p WHERE coalesce(emailaddress, email_id) IS NOT NULL
"""


def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Values at paths of JSON payloads; a missing index or field is null."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing[3].x").alias("missing"))
    return e.select("event_id", "k", F.col("missing").isNull().alias("missing"))


JSON_PATHS = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing[3].x') IS NULL AS missing FROM events"


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Short lines that stand in several documents of a source, with the first of them."""
    t = table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    t = t.where((F.length("line") <= 60) & (F.trim("line") != "") & F.col("source").isNotNull())
    g = t.groupBy("source", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return g.where("n_docs > 1")


REPEATED_LINES = r"""
WITH t AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IS NOT NULL)
SELECT source, line, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM t WHERE length(line) <= 60 AND trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) > 1
"""


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and records by source."""
    return table(spark, d, "evidence").groupBy("source_id").agg(F.count(F.lit(1)).alias("evidence_emitted"), F.count_distinct("record_id").alias("records_read"))


SOURCE_STATS = "SELECT source_id, count(*) AS evidence_emitted, count(DISTINCT record_id) AS records_read FROM evidence GROUP BY source_id"


def elements_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each cluster with the sources that name them."""
    e = table(spark, d, "evidence").where(F.col("field_path").isin("emails", "phones", "current_company")).withColumn("value", value_or_null(F.col("value_text"))).where("value IS NOT NULL")
    c = e.join(table(spark, d, "source_records").select("record_id", "cluster_id").distinct(), "record_id")
    return c.groupBy("cluster_id", "field_path", "value").agg(F.array_join(F.array_sort(F.collect_set("source_id")), "|").alias("sources"), F.bool_or("normalized").alias("normalized"))


ELEMENTS_BY_SOURCE = f"""
SELECT cluster_id, field_path, trim(value_text) AS value, array_to_string(list_sort(list(DISTINCT source_id)), '|') AS sources, bool_or(normalized) AS normalized
FROM evidence JOIN (SELECT DISTINCT record_id, cluster_id FROM source_records) USING (record_id) WHERE field_path IN ('emails', 'phones', 'current_company') AND {_HAS.format("value_text")} GROUP BY ALL
"""


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user with the one before, and the first known value of the day."""
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.lag("event_type").over(w).alias("previous_type"), F.first("value", ignorenulls=True).over(W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")).alias("first_value"))


FIRST_SEEN = """
SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_type,
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS first_value FROM events
"""


def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """The streaming query over a table at rest: counts per hour and type."""
    w = event_windows(table(spark, d, "events"))
    return w.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("total", 2).alias("total"))


EVENT_HOURS = "SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from both candidate tables to profiles under the recruiter view."""
    return _projected(spark, d, RECRUITER_VIEW)


def profiles_default(spark: SparkSession, d: str) -> DataFrame:
    """The same under the identity view, with provenance under the names of the query."""
    r = _projected(spark, d, DEFAULT)
    return r.withColumns({c: F.to_json(c) for c, t in r.dtypes if t.startswith(("struct", "array", "map"))})


def _projected(spark: SparkSession, d: str, config: dict) -> DataFrame:
    atoms = _people_atoms(spark, d)
    month, _ = merge.derive_as_of(atoms)
    who = identity.resolve(atoms)
    merged = merge.merge(atoms, who.members, who.clusters, who.refusals.select("key").distinct(), month)
    records = project(merged.profiles, compile_query(config))[0]
    return records.drop("__years_lexeme").withColumns({c: F.to_json(c) for c, t in records.dtypes if t.startswith(("struct", "map")) and config is RECRUITER_VIEW})


_ALL: dict[str, tuple[Query, str | None]] = {
    "p2_found": (p2_found, P2_SQL), "p3_found": (p3_found, None), "evidence_unpivot": (evidence_unpivot, EVIDENCE_UNPIVOT), "email_extract": (email_extract, EMAIL_EXTRACT),
    "email_match_key": (email_match_key, EMAIL_MATCH_KEY), "phone_candidates": (phone_candidates, PHONE_CANDIDATES),
    "url_classify": (url_classify, URL_CLASSIFY), "skill_scan": (skill_scan, SKILL_SCAN), "null_markers": (null_markers, NULL_MARKERS), "block_links": (block_links, BLOCK_LINKS),
    "multi_identity": (multi_identity, MULTI_IDENTITY), "connected_components": (connected_components, CONNECTED_COMPONENTS), "guarded_clusters": (guarded_clusters, operator_queries.GUARDED_CLUSTERS),
    "union_refusals": (union_refusals, operator_queries.UNION_REFUSALS), "name_compatibility": (name_compatibility, NAME_COMPATIBILITY), "noisy_or": (noisy_or, NOISY_OR), "survivorship": (survivorship, SURVIVORSHIP),
    "scalar_confidence": (scalar_confidence, SCALAR_CONFIDENCE), "atomic_location": (atomic_location, ATOMIC_LOCATION), "set_ranking": (set_ranking, SET_RANKING),
    "overall_confidence": (overall_confidence, OVERALL_CONFIDENCE), "same_job_groups": (same_job_groups, SAME_JOB_GROUPS), "years_experience": (years_experience, YEARS_EXPERIENCE),
    "partial_date_parse": (partial_date_parse, PARTIAL_DATE_PARSE), "country_alias": (country_alias, COUNTRY_ALIAS), "contested_keys": (contested_keys, CONTESTED_KEYS),
    "candidate_ids": (candidate_ids, CANDIDATE_IDS), "projection_on_missing": (projection_on_missing, PROJECTION_ON_MISSING), "json_paths": (json_paths, JSON_PATHS),
    "repeated_lines": (repeated_lines, REPEATED_LINES), "source_stats": (source_stats, SOURCE_STATS),
    "elements_by_source": (elements_by_source, ELEMENTS_BY_SOURCE), "first_seen": (first_seen, FIRST_SEEN), "event_hours": (event_hours, EVENT_HOURS),
    "profiles": (profiles, None), "profiles_default": (profiles_default, None),
    **operator_queries.ALL,
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
