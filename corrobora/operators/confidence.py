"""Confidence: strengths, corroboration counted once per source, noisy-or, support and the weighted overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions import dictionaries as D


def _map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def trust(source_type: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(D.SOURCE_TRUST), source_type), F.lit(0.0))


def reliability(method: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(D.METHOD_RELIABILITY), F.split_part(method, F.lit(":"), F.lit(1))), F.lit(0.0))


def noisy_or(strength: Column) -> Column:
    """Aggregate: 1 minus the product of what each source leaves open."""
    return F.lit(1.0) - F.product(F.lit(1.0) - strength)


def noisy_or_array(strengths: Column) -> Column:
    """The same over an array, in its sorted order."""
    return F.aggregate(F.array_sort(strengths), F.lit(1.0), lambda a, s: a * (1 - s), lambda a: 1 - a)


def value_support(atoms: DataFrame, by: list[str], value: str, source: str = "source_id", strength: str = "strength") -> DataFrame:
    """(by, value, agreement, support): per value, the strongest atom of each source, joined by noisy-or and added up."""
    per_source = atoms.groupBy(*by, value, source).agg(F.max(strength).alias("s"))
    return per_source.groupBy(*by, value).agg(noisy_or(F.col("s")).alias("agreement"), F.sum("s").alias("support"))


def scalar_confidence(values: DataFrame, by: list[str], rank: list[Column]) -> DataFrame:
    """One row per group: the value that ranks first and its agreement times its share of all support."""
    best = F.min_by(F.struct("*"), F.struct(*rank)).alias("w")
    g = values.groupBy(*by).agg(best, F.sum("support").alias("total"))
    return g.select(*by, "w", (F.col("w.agreement") * F.col("w.support") / F.col("total")).alias("confidence"))


def overall(field_confidence: Column) -> Column:
    """Weighted mean of a map of field confidences; a missing field counts 0."""
    got = sum((F.lit(float(w)) * F.coalesce(F.try_element_at(field_confidence, F.lit(f)), F.lit(0.0)) for f, w in D.FIELD_WEIGHTS.items()), F.lit(0.0))
    return got / float(sum(D.FIELD_WEIGHTS.values()))
