"""Continuous periods and gaps from overlapping, nested and broken month intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrobora.functions.values import strip

#: English month names, of which the first three letters are read.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Words that mark an open end.
CURRENT_WORDS = ("present", "current", "now", "ongoing")


def month_number(year: Column, month: Column, default: int) -> Column:
    """Months since year 0; a month outside 1..12 counts as default."""
    m = F.when(month.between(1, 12), month).otherwise(F.lit(default))
    return (year * 12 + m - 1).cast("int")


def yyyymm(n: Column) -> Column:
    return (F.floor(n / 12) * 100 + n % 12 + 1).cast("int")


def _dated(raw: Column) -> Column:
    """A freely written date as yyyy|m or yyyy|; anything else as it is.

    Reads 2016, in 2016, 2016-05, 2016.05, 2016/5, 5/2016, 2016-05-22, May 2016, MAY-2016, 22 May 2016.
    """
    s = F.lower(strip(raw))
    for pattern, to in (
        (r"^(\d{4})[-./](\d{1,2})(?:[-./]\d{1,2})?(?:t.*)?$", "$1|$2"),
        (r"^(\d{1,2})[-./](\d{4})$", "$2|$1"),
        (r"^(?:\d{1,2}[\s-]+)?(" + "|".join(MONTHS) + r")[a-z]*\.?[\s,-]+(\d{4})$", "$2|$1"),
        (r"^(?:in\s+)?(\d{4})$", "$1|"),
    ):
        s = F.regexp_replace(s, pattern, to)
    return s


def parse_month(raw: Column, prefix: str) -> Column:
    """A generator of <prefix>y and <prefix>m, from one evaluation of the date; both null if there is no year."""

    def fields(x: Column) -> Column:
        parts = F.split(F.when(x.rlike(r"^\d{4}\|"), x), r"\|")
        m = F.get(parts, F.lit(1))
        number = F.when(m.rlike("^[a-z]"), F.array_position(F.array(*[F.lit(n) for n in MONTHS]), m)).when(m != "", m.cast("bigint"))
        return F.struct(F.get(parts, F.lit(0)).cast("int").alias(f"{prefix}y"), number.cast("int").alias(f"{prefix}m"))

    return F.inline(F.transform(F.array(_dated(raw)), fields))


def post_months(posts: DataFrame, as_of: int) -> DataFrame:
    """(record_id, s, e) month numbers, both included, of the posts that count.

    posts: record_id, sy, sm, ey, em, current. A post counts if it has a start year, an end year or the current mark,
    doesn't end before it starts and doesn't start after as_of (a month number); later ends are cut to as_of.
    """
    s = month_number(F.col("sy"), F.col("sm"), 1)
    e = F.when(F.col("ey").isNotNull(), month_number(F.col("ey"), F.col("em"), 12)).when(F.col("current"), F.lit(as_of))
    return (
        posts.select("record_id", s.alias("s"), e.alias("e"))
        .where(F.col("record_id").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("e") >= F.col("s")) & (F.col("s") <= as_of))
        .withColumn("e", F.least("e", F.lit(as_of)))
    )


def merge_periods(posts: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, s, e): the months covered without a break. posts: key, s, e as month numbers, both included.

    A month is laid out as one day of a made-up calendar and session_window with each row's own duration merges the
    overlaps; sessions that only touch are joined afterwards. Repeated rows and equal starts are folded before the
    shuffle, so a key holds at most one row per start month however many rows it has. Empty input gives no rows.
    """
    folded = posts.groupBy(key, "s").agg(F.max("e").alias("e"))
    at = folded.select(key, F.timestamp_seconds(F.col("s").cast("long") * 86400).alias("at"), F.concat((F.col("e") - F.col("s") + 1) * 24, F.lit(" hours")).alias("span"))
    day = lambda c: (F.unix_timestamp(c) / 86400).cast("int")
    merged = (
        at.groupBy(key, F.session_window("at", F.col("span")).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, day(F.col("w.start")).alias("s"), day(F.col("w.end")).alias("x"))
    )
    order = W.partitionBy(key).orderBy("s", "x")
    before = F.max("x").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return merged.withColumn("i", island).groupBy(key, "i").agg(F.min("s").alias("s"), (F.max("x") - 1).alias("e")).drop("i")


def periods_and_gaps(periods: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, kind, first_month, last_month): each period, and the months between two successive periods as a gap."""
    nxt = F.lead("s").over(W.partitionBy(key).orderBy("s"))
    parts = periods.withColumn("n", nxt).select(
        key,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")),
                    F.struct(F.lit("gap").alias("kind"), (F.col("e") + 1).alias("a"), (F.col("n") - 1).alias("b")),
                ),
                lambda x: x["b"].isNotNull(),
            )
        ).alias("x"),
    )
    return parts.select(key, "x.kind", yyyymm(F.col("x.a")).alias("first_month"), yyyymm(F.col("x.b")).alias("last_month"))


def posts_of(linkedin: DataFrame, history: DataFrame, company: bool = False) -> DataFrame:
    """The posts of both tables in one shape: record_id, sy, sm, ey, em, current, and on demand the company."""
    at = lambda c: [F.col(c).alias("company")] if company else []
    kept = ["company"] if company else []
    a = linkedin.select(
        "record_id", *at("companyname"), F.col("start_year").alias("sy"), F.col("start_month").alias("sm"), F.col("end_year").alias("ey"), F.col("end_month").alias("em"),
        F.coalesce("iscurrent", F.lit(False)).alias("current"),
    )
    current = F.coalesce(F.lower(strip(F.col("to_raw"))).isin(*CURRENT_WORDS), F.lit(False)).alias("current")
    b = history.select("record_id", *at("org"), "to_raw", parse_month(F.col("from_raw"), "s")).select("record_id", *kept, "sy", "sm", current, parse_month(F.col("to_raw"), "e"))
    return a.unionByName(b)


def continuous_periods(linkedin: DataFrame, history: DataFrame, as_of: tuple[int, int] = (2026, 8)) -> DataFrame:
    """Periods and gaps of every record of linkedin_positions and ats_work_history.

    Rows without record_id or without usable months give nothing; ties and repeated rows count once; other columns are ignored.
    """
    n = as_of[0] * 12 + as_of[1] - 1
    return periods_and_gaps(merge_periods(post_months(posts_of(linkedin, history), n)))
