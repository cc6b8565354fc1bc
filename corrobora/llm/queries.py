"""Queries of the operators of this subpackage over a data folder, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import canonical, drift, groups, leaks, linkage, quality, survivor, tokens
from corrobora.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p1_found with their confidence."""
    return linkage.linked_people(linkage.ats_people(table(spark, d, "t1_ats")), linkage.roster_people(table(spark, d, "t1_roster")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).select(F.col("left_id").alias("ats_record_id"), F.col("right_id").alias("roster_record_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.candidate_terms(table(spark, d, "t1_ats"), table(spark, d, "skill_aliases"), table(spark, d, "country_aliases"), table(spark, d, "ats"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Per field, how many values have an entry and how many have none."""
    return p4_found(spark, d).groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("canonical") == canonical.UNMATCHED).alias("n_unmatched"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "match_pairs"))


P5_SQL = r"""
WITH RECURSIVE
s AS (SELECT trim(left_record, chr(9) || ' ') AS l, trim(right_record, chr(9) || ' ') AS r, lower(trim(outcome)) AS o FROM match_pairs),
c AS (SELECT CASE WHEN lower(l) IN ('','n/a','-','—','none','null','unknown') THEN NULL ELSE l END AS l,
             CASE WHEN lower(r) IN ('','n/a','-','—','none','null','unknown') THEN NULL ELSE r END AS r, o FROM s),
ids AS (SELECT l AS id FROM c WHERE l IS NOT NULL UNION SELECT r FROM c WHERE r IS NOT NULL),
e AS (SELECT l AS a, r AS b FROM c WHERE o = 'merged' AND l IS NOT NULL AND r IS NOT NULL AND l <> r
      UNION SELECT r, l FROM c WHERE o = 'merged' AND l IS NOT NULL AND r IS NOT NULL AND l <> r),
reach(id, g) AS (SELECT id, id FROM ids UNION SELECT e.b, reach.g FROM reach JOIN e ON e.a = reach.id WHERE reach.g < e.b)
SELECT id AS record_id, min(g) AS group_id FROM reach GROUP BY id
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivor.surviving_evidence(table(spark, d, "source_records"), table(spark, d, "evidence"), table(spark, d, "scoring_weights"), with_value=False)
    return best.select("cluster_id", "field_path", "record_id", "order_index")


_DAY_SQL = r"""
  CASE WHEN regexp_matches(u, '^\d{9,11}$') THEN CAST(to_timestamp(CAST(u AS BIGINT)) AT TIME ZONE 'UTC' AS DATE)
       WHEN regexp_matches(u, '^\d{4}[-/.]?\d{2}[-/.]?\d{2}([t ]\d{1,2}:\d{2}.*)?$')
         THEN TRY_CAST(regexp_replace(u, '^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2}).*$', '\1-\2-\3') AS DATE)
       WHEN regexp_matches(u, '^[a-z]{3} \d{1,2}, \d{4}$') THEN CAST(try_strptime(u, '%b %-d, %Y') AS DATE)
       WHEN regexp_matches(u, '^\d{1,2} [a-z]{3} \d{4}$') THEN CAST(try_strptime(u, '%-d %b %Y') AS DATE) END
"""
_EVIDENCE_SQL = rf"""
ev AS (SELECT record_id, source_id, field_path, order_index, trim(value_text) AS v, regexp_replace(lower(trim(source_type)), '[\s_-]+', '_', 'g') AS st,
         lower(trim(split_part(method, ':', 1))) AS mf FROM evidence),
w AS (SELECT ev.*, coalesce(a.weight, 0) AS trust, coalesce(b.weight, 0) AS rel,
        CASE WHEN field_path = 'location' AND json_valid(v) THEN coalesce(len(list_filter(json_extract_string(v, '$.*'), lambda x: x IS NOT NULL)), 0) ELSE 0 END AS complete
      FROM ev LEFT JOIN scoring_weights a ON a.kind = 'source_trust' AND a.entry = st LEFT JOIN scoring_weights b ON b.kind = 'method_reliability' AND b.entry = mf
      WHERE lower(v) NOT IN ('','n/a','-','—','none','null','unknown')),
d AS (SELECT record_id, cluster_id, max({_DAY_SQL}) AS day FROM (SELECT record_id, cluster_id, lower(trim(updated_at)) AS u FROM source_records) GROUP BY ALL)
"""
P6_SQL = f"""
WITH {_EVIDENCE_SQL},
r AS (SELECT cluster_id, field_path, w.record_id, order_index, row_number() OVER (PARTITION BY cluster_id, field_path
        ORDER BY complete DESC, trust DESC, rel DESC, day DESC NULLS LAST, source_id, w.record_id, order_index) AS k FROM w JOIN d ON w.record_id = d.record_id)
SELECT cluster_id, field_path, record_id, order_index FROM r WHERE k = 1
"""

#: The fields of the canonical record that evidence holds.
FIELDS = ["full_name", "emails", "phones", "location", "current_company", "headline", "years_experience"]


def p6_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivor.golden_records(table(spark, d, "source_records"), table(spark, d, "evidence"), table(spark, d, "scoring_weights"), FIELDS, "2026-08-31")


P6_GOLDEN_SQL = rf"""
WITH {_EVIDENCE_SQL},
u AS (SELECT DISTINCT record_id, source_id, field_path, order_index, v, trust, rel, complete FROM w),
a AS (SELECT cluster_id, field_path, v AS written, regexp_replace(lower(v), '\s+', ' ', 'g') AS v,
        CAST(round(trust * rel * pow(2.0, -greatest(coalesce(date_diff('day', day, DATE '2026-08-31'), 730), 0) / 365), 6) AS DECIMAL(12,6)) AS vote FROM u JOIN d ON u.record_id = d.record_id),
s AS (SELECT cluster_id, field_path, v, sum(vote) AS votes, first(written ORDER BY vote DESC, written) AS written FROM a GROUP BY ALL),
f AS (SELECT cluster_id, field_path, written AS v FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field_path ORDER BY votes DESC, v) AS k FROM s) WHERE k = 1)
SELECT cluster_id, {", ".join(f"max(v) FILTER (WHERE field_path = '{c}') AS {c}" for c in FIELDS)} FROM f GROUP BY cluster_id
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "ats_drops")).select("file_name", "change_kind", "field_name", "new_name")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    drops = table(spark, d, "ats_drops")
    return drift.consistent_table(drops, drift.schema_changes(drops))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("kind = 'verbatim'").select("doc_id", "item_id")


def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that say an item's passage in other words or with words between, answers included."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).where("kind = 'paraphrase'").drop("kind")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leaks.item_report(leaks.leaked_items(table(spark, d, "documents"), items), items)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.non_prose(table(spark, d, "documents")).select("doc_id", "kind")


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    """All statistics, outlier scores and kinds."""
    return quality.quality(table(spark, d, "documents"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"))


#: Blanks of all kinds, for DuckDB's expressions.
_BLANKS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
P10_STATS_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract(lower(trim(lang)), '^([a-z]+)', 1), '') AS lang, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, lang, CAST(length(t) AS INT) AS n_chars,
        CAST(len(list_filter(string_split_regex(t, '[{_BLANKS}]+'), lambda w: w <> '')) AS INT) AS n_words,
        length(regexp_replace(t, '[{_BLANKS}]+', '', 'g')) AS solid, length(regexp_replace(t, '[\p{{L}}\p{{N}}{_BLANKS}]+', '', 'g')) AS symbols,
        list_filter(string_split_regex(t, '\r\n|\r|\n'), lambda s: regexp_matches(s, '[^{_BLANKS}]')) AS ls FROM t)
SELECT doc_id, lang, n_chars, n_words, round(CASE WHEN n_words > 0 THEN solid / n_words ELSE 0 END, 6) AS mean_word_length,
  round(CASE WHEN solid > 0 THEN symbols / solid ELSE 0 END, 6) AS symbol_ratio,
  round(CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda s: regexp_matches(s, '[.!?…。！？]["''”»)）]*\s*$'))) / len(ls) ELSE 0 END, 6) AS line_end_ratio FROM n
"""


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    stats = quality.text_statistics(table(spark, d, "documents"))
    scores = quality.outlier_scores(stats, "doc_id", "lang", ["n_words", "mean_word_length", "symbol_ratio", "line_end_ratio"])
    return scores.select("doc_id", (F.round("score", 3) + 0.0).alias("score"), "pool")


_TAILS = " + ".join(
    f"-ln(least(1.0, 2 * least(cume_dist() OVER (PARTITION BY lang ORDER BY {c}), cume_dist() OVER (PARTITION BY lang ORDER BY {c} DESC))))"
    for c in ("n_words", "mean_word_length", "symbol_ratio", "line_end_ratio")
)
P10_SCORES_SQL = f"WITH s AS ({P10_STATS_SQL}) SELECT doc_id, round(round(0.0 + {_TAILS}, 6), 3) + 0.0 AS score, count(*) OVER (PARTITION BY lang) AS pool FROM s"


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_links": p1_links, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p5_found": p5_found, "p6_found": p6_found, "p6_golden": p6_golden,
        "p7_found": p7_found, "p7_table": p7_table, "p8_ids": p8_ids,
        "p9_found": p9_found, "p9_paraphrases": p9_paraphrases, "p9_report": p9_report, "p10_found": p10_found, "p10_quality": p10_quality, "p10_stats": p10_stats, "p10_scores": p10_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL, "p6_found": P6_SQL, "p6_golden": P6_GOLDEN_SQL, "p10_stats": P10_STATS_SQL, "p10_scores": P10_SCORES_SQL}
