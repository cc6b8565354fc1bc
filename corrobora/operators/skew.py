"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of the rows, so there are never more than 1 / HOT_SHARE hot keys: that bounds the broadcast.
HOT_SHARE = 1 / 500


def hot_keys(keyed: DataFrame, weight: str, total: int | None = None) -> tuple[DataFrame, float]:
    """Rows of keyed whose weight is above HOT_SHARE of the total, and that limit. keyed has one row per key."""
    if total is None:
        total = keyed.agg(F.sum(weight)).first()[0] or 0
    limit = max(float(total) * HOT_SHARE, 1.0)
    return keyed.where(F.col(weight) > limit), limit


def lookup(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int | None = None, how: str = "left") -> DataFrame:
    """rows joined to keyed (one row per key, with the number of rows of that key in weight).

    Hot keys, at most 1 / HOT_SHARE of them, travel as a broadcast, so their rows aren't shuffled; the
    other keys meet in a shuffle join in which no key holds more than HOT_SHARE of the rows. Null keys match nothing.
    """
    hot, limit = hot_keys(keyed, weight, total)
    values = [c for c in keyed.columns if c not in on and c != weight]
    packed = F.struct(*[F.col(c) for c in values]) if values else F.struct(F.lit(1).alias("__one"))
    near = rows.join(F.broadcast(hot.select(*on, packed.alias("__hot"))), on, "left")
    cold = keyed.where(F.col(weight) <= limit).select(*on, packed.alias("__cold"))
    is_hot = F.col("__hot").isNotNull()
    a = near.where(is_hot).withColumn("__at", F.col("__hot"))
    b = near.where(~is_hot).drop("__hot").join(cold, on, how).withColumn("__at", F.col("__cold"))
    both = a.select(*rows.columns, "__at").unionByName(b.select(*rows.columns, "__at"))
    return both.select(*rows.columns, *[F.col("__at")[c].alias(c) for c in values])
