"""Problem 6: the one surviving value of each field of a group of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.values import strip, value_or_null

#: English month names by their first three letters.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def day_of(raw: Column) -> Column:
    """The day of an untidy date, null if unreadable.

    Reads ISO dates and times, 2025/07/22, 20250929, epoch seconds, May 7, 2026 and 29 Jun 2025.
    """

    def read(s: Column) -> Column:
        epoch = F.when(s.rlike(r"^\d{9,11}$"), F.to_date(F.timestamp_seconds(s.cast("bigint"))))
        iso = F.regexp_replace(s, r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?:[t ]\d{1,2}:\d{2}.*)?$", "$1-$2-$3")
        return F.coalesce(epoch, F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso.try_cast("date")))

    s = F.lower(strip(raw))
    named = r"^([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$"
    turned = r"^(\d{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})$"
    s = F.regexp_replace(F.regexp_replace(s, named, "$3 $1 0$2"), turned, "$3 $2 0$1")

    def spelled(x: Column) -> Column:
        p = F.split(x, " ")
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.get(p, F.lit(1)))
        whole = F.concat(F.get(p, F.lit(0)), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.substring(F.get(p, F.lit(2)), -2, 2))
        return F.when(x.rlike(r"^\d{4} [a-z]{3} \d{2,3}$"), whole).otherwise(x)

    return F.get(F.transform(F.transform(F.array(s), spelled), read), F.lit(0))


def fold_type(c: Column) -> Column:
    """A source type without case and separators."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s_-]+", "_")


def method_family(c: Column) -> Column:
    return F.lower(strip(F.split_part(c, F.lit(":"), F.lit(1))))


def _weights(weights: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    """At most one row per entry of a fixed table of a few rows, which is what may be broadcast."""
    w = weights.where(F.lower(strip(F.col("kind"))) == kind)
    return F.broadcast(w.groupBy(fold_type(F.col("entry")).alias(key)).agg(F.max("weight").cast("double").alias(name)))


def weighed(evidence: DataFrame, weights: DataFrame) -> DataFrame:
    """Evidence rows that have a value, with trust, reliability and completeness; unknown types and methods weigh 0."""
    e = evidence.select(
        "record_id", "source_id", "field_path", "order_index", value_or_null(F.col("value_text")).alias("value"),
        fold_type(F.col("source_type")).alias("st"), method_family(F.col("method")).alias("mf"),
    ).where(F.col("record_id").isNotNull() & F.col("field_path").isNotNull() & F.col("value").isNotNull())
    e = e.join(_weights(weights, "source_trust", "st", "trust"), "st", "left").join(_weights(weights, "method_reliability", "mf", "reliability"), "mf", "left")
    parts = F.size(F.filter(F.map_values(F.from_json("value", "map<string,string>")), lambda x: x.isNotNull()))
    complete = F.when(F.col("field_path") == "location", F.greatest(F.coalesce(parts, F.lit(0)), F.lit(0))).otherwise(0)
    return e.select(
        "record_id", "source_id", "field_path", "order_index", "value",
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("reliability", F.lit(0.0)).alias("reliability"), complete.alias("complete"),
    )


def record_days(records: DataFrame) -> DataFrame:
    """(record_id, cluster_id, day): the latest readable day of a record's updated_at."""
    r = records.where(F.col("record_id").isNotNull() & F.col("cluster_id").isNotNull())
    return r.groupBy("record_id", "cluster_id").agg(F.max(day_of(F.col("updated_at"))).alias("day"))


def _last(c: str) -> Column:
    """Ascending order with null last."""
    return F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v")).alias(c)


def surviving_evidence(records: DataFrame, evidence: DataFrame, weights: DataFrame, with_value: bool = True) -> DataFrame:
    """(cluster_id, field_path, record_id, order_index[, value]): the evidence row that survives for each cluster and field.

    Order: for location the most non-null JSON parts; then trust, reliability, latest day of the record (unreadable or
    missing last), smallest source_id, record_id, order_index. Rows whose value is a null mark, and rows of records
    that are in no cluster, don't count; repeated rows are one; a null source_id or order_index comes last.
    The best row of a record is found before records and clusters meet, so a record or cluster with a large share of
    all rows is folded by partial aggregates and never gathered. What is shuffled is the sort key itself, which ends with
    the row's position and, only if asked for, its value.
    """
    rank = [(-F.col("complete")).cast("short").alias("c"), (-F.col("trust")).cast("float").alias("t"), (-F.col("reliability")).cast("float").alias("r")]
    payload = [F.col("value")] if with_value else []
    own = weighed(evidence, weights).groupBy("record_id", "field_path").agg(F.min(F.struct(*rank, _last("source_id"), _last("order_index"), *payload)).alias("e"))
    met = own.join(record_days(records), "record_id")
    day = F.coalesce(-F.unix_date("day"), F.lit(2**31 - 1)).alias("d")
    key = F.struct("e.c", "e.t", "e.r", day, "e.source_id", "record_id", "e.order_index", *([F.col("e.value")] if with_value else []))
    best = met.groupBy("cluster_id", "field_path").agg(F.min(key).alias("e"))
    return best.select("cluster_id", "field_path", "e.record_id", F.col("e.order_index.v").alias("order_index"), *(["e.value"] if with_value else []))


def golden_records(records: DataFrame, evidence: DataFrame, weights: DataFrame, fields: list[str], as_of: str, half_life_days: int = 365) -> DataFrame:
    """One built record per cluster: of every field the value with most votes, as its strongest row writes it, pivoted back to columns.

    A row votes trust x reliability x 2^(-age / half_life_days) for its value, case and blanks aside; age counts back
    from as_of and an unreadable day has the age of two half-lives. Votes are exact decimals, so their sum doesn't
    depend on the order of rows; ties go to the smaller value. Fields without a value are null.
    """
    w = weighed(evidence, weights).distinct()
    met = w.join(record_days(records), "record_id")
    age = F.greatest(F.coalesce(F.datediff(F.lit(as_of).cast("date"), "day"), F.lit(2 * half_life_days)), F.lit(0))
    vote = F.round(F.col("trust") * F.col("reliability") * F.pow(F.lit(2.0), -age / half_life_days), 6).cast("decimal(12,6)")
    norm = F.regexp_replace(F.lower("value"), r"\s+", " ")
    cast = met.select("cluster_id", "field_path", norm.alias("v"), "value", vote.alias("vote"))
    sums = cast.groupBy("cluster_id", "field_path", "v").agg(F.sum("vote").alias("votes"), F.min(F.struct((-F.col("vote")).alias("o"), "value"))["value"].alias("written"))
    first = sums.groupBy("cluster_id", "field_path").agg(F.min(F.struct((-F.col("votes")).alias("o"), "v", "written"))["written"].alias("v"))
    return first.groupBy("cluster_id").pivot("field_path", fields).agg(F.first("v"))
