"""Problem 10: statistics of every text, their exact ranks by language, and the texts that are no prose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrobora.llm.measures import STATISTICS, document_words, measure, portions
from corrobora.operators.layout import spread
from corrobora.operators.skew import lookup
from corrobora.session import cut

#: A word is common if it is in this share of all documents: so there are at most mean distinct words / share of them.
COMMON_SHARE = 0.005
#: Per kind: the statistics whose tails speak for it, the side of the tail, and where a text stands that is half of that kind.
#: A text is of a kind if its joint tail in its language is as far out as that of such a half text, so the ranks decide and
#: no share of a kind in the corpus, however large, moves the decision.
HIGH, LOW = "high", "low"
HALF_TEXTS = {
    "table": {"column_share": (HIGH, 0.5), "sentence_ratio": (LOW, 0.05)},
    "junk": {"unreadable_share": (HIGH, 0.5), "plain_ratio": (LOW, 0.4)},
    "list": {"item_share": (HIGH, 0.5), "sentence_ratio": (LOW, 0.05)},
}


def language(c: Column) -> Column:
    """A language label without case and region; empty text for none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1), F.lit(""))


def pool_of(lang: Column) -> Column:
    """The language under which a text is ranked: two letters, so that de and deu rank together."""
    return F.substring(lang, 1, 2)


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang, n_chars, n_words, mean_word_length, symbol_ratio, line_end_ratio) of every text, by built-in functions.

    Words are what blanks separate; symbols are all characters but letters, digits and blanks; a line counts if it isn't
    blank. n_chars is counted, not taken from the table. Null and blank texts have zeros. One row per row of documents.
    """
    d = documents.select(key, language(F.col(lang)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"), *keep)
    words = F.size(F.filter(F.split("t", r"(?U)\s+"), lambda w: w != ""))
    solid = F.length(F.regexp_replace("t", r"(?U)\s+", ""))
    symbols = F.length(F.regexp_replace("t", r"[\p{L}\p{N}]+|(?U:\s+)", ""))
    lines = F.filter(F.split("t", r"\r\n|\r|\n"), lambda s: s.rlike(r"(?U)\S"))
    ended = F.size(F.filter(lines, lambda s: s.rlike(r"[.!?…。！？][\"'”»)）]*\s*$")))
    n = d.select(key, "lang", F.length("t").alias("n_chars"), words.alias("n_words"), solid.alias("solid"), symbols.alias("symbols"), F.size(lines).alias("n_lines"), ended.alias("n_ended"), *keep)
    ratios = _ratio("solid", "n_words").alias("mean_word_length"), _ratio("symbols", "solid").alias("symbol_ratio"), _ratio("n_ended", "n_lines").alias("line_end_ratio")
    return n.select(key, "lang", "n_chars", "n_words", *ratios, *keep)


def _ratio(a: str, b: str) -> Column:
    return F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)


def common_words(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Numbers of the words that stand in COMMON_SHARE of the texts, counted over all of them, in order.

    Each batch is folded to its distinct words before anything is shuffled.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in portions(list(pdf[text])):
                w, n = document_words(part)
                yield pd.DataFrame({"w": np.append(w, 0), "n": np.append(n, len(part)), "total": np.append(np.zeros(len(w), dtype=bool), True)})

    sums = cut(documents.select(text).mapInPandas(counted, "w bigint, n bigint, total boolean").groupBy("w", "total").agg(F.sum("n").alias("n")))
    total = sums.where("total").agg(F.max("n")).first()[0] or 0
    rows = sums.where(~F.col("total") & (F.col("n") >= max(2, COMMON_SHARE * total))).select("w").collect()
    return np.sort(np.array([r.w for r in rows], dtype=np.int64))


def measured(documents: DataFrame, common: np.ndarray, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, STATISTICS) of every row, in one narrow pass over whole texts. Null and blank texts have zeros."""

    @F.pandas_udf("struct<" + ",".join(f"{n}:{'int' if n in ('n_chars', 'n_words') else 'double'}" for n in STATISTICS) + ">")
    def all_(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            parts = [measure(part, common) for part in portions(list(s))]
            yield pd.DataFrame({n: np.concatenate([m[n] for m in parts]) if parts else np.zeros(0) for n in STATISTICS})

    return documents.select(key, language(F.col(lang)).alias("lang"), all_(text).alias("m")).select(key, "lang", "m.*")


def tail_ranks(rows: DataFrame, key: str, group: str, names: list[str]) -> DataFrame:
    """(key, group, stat, value, p_low, p_high): exact shares of the group's rows with a value as low, and as high.

    Equal values are folded first; the distinct values are range-partitioned and sorted, numbered within their partition,
    and the counts of the partitions before are added as offsets, so no language is sorted in one task. Ranks return to the
    rows by a lookup in which frequent values don't gather. Ties share a rank.
    """
    long = rows.select(key, group, F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select(key, group, "x.stat", "x.value")
    counts = long.groupBy(group, "stat", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(parts, group, "stat", "value").withColumn("part", F.spark_partition_id()))
    local = placed.withColumn("upto", F.sum("n").over(W.partitionBy("part", group, "stat").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
    ends = placed.groupBy(group, "stat", "part").agg(F.sum("n").alias("in_part"))
    line = W.partitionBy(group, "stat")
    offsets = ends.select(group, "stat", "part", (F.sum("in_part").over(line.orderBy("part")) - F.col("in_part")).alias("before"), F.sum("in_part").over(line).alias("total"))
    at = local.join(offsets, [group, "stat", "part"])
    low = (F.col("before") + F.col("upto")) / F.col("total")
    high = (F.col("total") - F.col("before") - F.col("upto") + F.col("n")) / F.col("total")
    ranks = cut(at.select(group, "stat", "value", "n", low.alias("p_low"), high.alias("p_high"), F.col("total").alias("pool")))
    return lookup(long, ranks, [group, "stat", "value"], "n")


def _beyond(share: Column, pool: Column) -> Column:
    """-ln of an empirical tail probability, one text added to both sides, so no tail is empty."""
    return -F.ln((share * pool + 1) / (pool + 1))


def outlier_scores(rows: DataFrame, key: str, group: str, names: list[str]) -> DataFrame:
    """(key, score, pool): the sum over the statistics of -ln of the two-sided tail probability, at most 1; pool is the size of the group."""
    p = tail_ranks(rows, key, group, names)
    tail = F.least(F.lit(1.0), 2 * F.least("p_low", "p_high"))
    return p.groupBy(key).agg(F.round(F.sum(-F.ln(tail)), 6).alias("score"), F.max("pool").alias("pool"))


def kinds(rows: DataFrame, key: str, group: str) -> DataFrame:
    """(key, kind, margin): the kind of each row of the group whose joint tail is as far out as that of a half text of that kind.

    Tails of the statistics of HALF_TEXTS are added up per kind and compared with those of the half text in the same ranks; of
    several kinds the one with the largest margin counts. Rows of no kind are left out.
    """
    sides = sorted({(n, side) for t in HALF_TEXTS.values() for n, (side, _) in t.items()})
    p = tail_ranks(rows, key, group, sorted({n for n, _ in sides}))
    tail = {(n, s): F.max(F.when(F.col("stat") == n, _beyond(F.col(f"p_{s}"), F.col("pool")))) for n, s in sides}
    out = p.groupBy(key, group).agg(*[tail[x].alias(f"{x[0]}_{x[1]}") for x in sides])
    size = F.count(F.lit(1))
    edge = {
        (n, s, v): _beyond(F.sum(((F.col(n) >= v) if s == HIGH else (F.col(n) <= v)).cast("double")) / size, size)
        for t in HALF_TEXTS.values() for n, (s, v) in t.items()
    }
    half = rows.groupBy(group).agg(*[sum((edge[n, s, v] for n, (s, v) in t.items()), F.lit(0.0)).alias(f"half_{k}") for k, t in HALF_TEXTS.items()])
    at = out.join(half, group)
    margins = [F.struct(F.round(sum((F.col(f"{n}_{s}") for n, (s, _) in t.items()), F.lit(0.0)) - F.col(f"half_{k}"), 9).alias("margin"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, (k, t) in enumerate(HALF_TEXTS.items())]
    best = at.select(key, F.array_max(F.array(*margins)).alias("x")).where("x.margin >= 0")
    return best.select(key, "x.kind", "x.margin")


def _rows(documents: DataFrame, key: str, text: str, lang: str, with_common: bool = True) -> DataFrame:
    d = spread(documents.select(key, text, lang).where(F.col(text).rlike(r"(?U)\S")))
    common = common_words(d, text) if with_common else np.zeros(0, dtype=np.int64)
    return cut(measured(d, common, key, text, lang).withColumn("pool_lang", pool_of(F.col("lang"))))


def quality(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, STATISTICS, kind, score, pool) of every text that isn't null or blank. key must be unique.

    score says how far out all statistics together lie among the texts of the language; kind is list, table or junk, or null
    for prose. Texts without a language label are ranked among themselves.
    """
    rows = _rows(documents, key, text, lang)
    at = rows.join(outlier_scores(rows, key, "pool_lang", list(STATISTICS)), key)
    return at.join(kinds(rows, key, "pool_lang").select(key, "kind"), key, "left").drop("pool_lang")


def non_prose(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, kind, score): the texts most of which is a list, a table or junk, by the tails of their statistics.

    score is the margin over a text that is half of that kind. No kind needs the common words, so they aren't counted here. Copies share their ranks and are judged like any other, however
    many there are. Null and blank texts are left out.
    """
    return kinds(_rows(documents, key, text, lang, with_common=False), key, "pool_lang").select(key, "kind", F.col("margin").alias("score"))
