"""Partition layout of narrow, CPU-heavy steps."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, shuffled: bool = False, per_core: int = 2) -> DataFrame:
    """df over at least per_core partitions a core; an input that has half of them already is left as it is.

    shuffled: the rows come out of a shuffle or a join, which lay them out themselves, so df is returned as it is. Otherwise
    df should come straight from storage: asking a shuffle for its partitions would run it.
    """
    if shuffled:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= want // 2 else df.repartition(want)
