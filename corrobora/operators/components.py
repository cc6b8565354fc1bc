"""Connected components by minimum labels, for the identity graph of records and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators.skew import lookup
from corrobora.session import cut


def min_label_components(links: DataFrame, node: str, hub: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node reaches through shared hubs. links: one row per node and hub.

    Each round gives every hub the smallest label of its nodes and every node the smallest of its hubs, then follows the
    label's own label, so long chains halve. Hubs and labels that many rows share travel as a bounded broadcast.
    """
    pairs = cut(links.select(node, hub).where(F.col(node).isNotNull() & F.col(hub).isNotNull()).distinct())
    labels = cut(pairs.select(node).distinct().withColumn("component", F.col(node)))
    n, mark = pairs.count(), _mark(labels, node)
    for _ in range(max_rounds):
        at = pairs.join(labels, node)
        low = at.groupBy(hub).agg(F.min("component").alias("low"), F.count(F.lit(1)).alias("n"))
        near = lookup(at, low, [hub], "n", n)
        new = near.groupBy(node).agg(F.min(F.least("low", "component")).alias("c"))
        sizes = new.groupBy("c").count()
        far = labels.select(F.col(node).alias("c"), F.col("component").alias("cc")).join(sizes, "c").withColumnRenamed("count", "n")
        labels = cut(lookup(new, far, ["c"], "n", mark[0]).select(node, F.least("c", "cc").alias("component")))
        last, mark = mark, _mark(labels, node)
        if mark == last:
            return labels
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def _mark(labels: DataFrame, node: str) -> tuple[int, int]:
    """Number of nodes and an order-free fingerprint of their labels."""
    r = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64(node, "component").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)
