"""Problem 5: one group id for all records linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrobora.functions.values import value_or_null
from corrobora.operators.skew import lookup
from corrobora.session import cut

#: Neighbours of one vertex (two numbers each) that one task may sort; as soon as one has more, hot vertices are met by a bounded broadcast.
GATHER = 100_000


def _with_low(rows: DataFrame, hot: bool, total: int) -> DataFrame:
    """rows (u, v) with the smallest v of each u as m: by one shuffle if no u has many rows, else by a lookup of its minimum."""
    if not hot:
        return rows.withColumn("m", F.min("v").over(W.partitionBy("u")))
    rows = cut(rows)
    return lookup(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), ["u"], "n", total)


def _large_star(edges: DataFrame, hot: bool, total: int) -> DataFrame:
    """Every neighbour v > u of u is linked to the smallest member of u's neighbourhood (u included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_low(both, hot, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, hot: bool, total: int) -> DataFrame:
    """Every neighbour v < u of u, and u itself, is linked to the smallest such neighbour. Edges have u > v."""
    near = _with_low(edges, hot, total)
    # u itself and the neighbours that are not m; where v is m, v is put in the place of u.
    ends = F.explode(F.array(F.col("u"), F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")))).alias("u")
    return near.select(ends, F.col("m").alias("v")).distinct()


def _written(edges: DataFrame, instead_of: DataFrame | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """edges with their lineage cut, their number and an order-free fingerprint, both taken while they are written."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), instead_of)
    return out, (seen.get["n"] or 0, int(seen.get["h"] or 0))


def _crowded(edges: DataFrame, n: int) -> bool:
    """Whether a vertex has more than GATHER neighbours; so few edges as that need no look."""
    if n <= GATHER:
        return False
    return bool(edges.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").count().where(F.col("count") > GATHER).limit(1).count())


def star_edges(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(u, v): each vertex of the edges (u > v, any comparable type) but the smallest of its component, with that one.

    Large-star and small-star rewrites alternate until neither changes an edge. As long as no vertex has more than GATHER
    neighbours, each rewrite costs one shuffle; beyond that, those with a large share of all edges are met by a broadcast.
    """
    edges, state = _written(edges.distinct())
    for _ in range(max_rounds):
        if not state[0]:
            return edges
        hot, last = _crowded(edges, state[0]), state
        edges, state = _written(_small_star(_large_star(edges, hot, state[0]), hot, state[0]), instead_of=edges)
        if state == last:
            return edges
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def numbered(ids: DataFrame, name: str) -> DataFrame:
    """(name, number): the distinct ids with numbers in their byte order: sorted by ranges, numbered within them."""
    own = ids.select(name).where(F.col(name).isNotNull()).distinct()
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(own.repartitionByRange(parts, name).sortWithinPartitions(name).withColumn("number", F.monotonically_increasing_id()))


def star_components(links: DataFrame, left: str, right: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, group_id): the smallest id, in byte order, of each component of the undirected links.

    The rewrites run over numbers in the order of the ids, which are smaller and faster to compare and to fold. Self links and
    nulls link nothing; ids without a link are not returned. ids: (id, number) as from numbered(), if they are known.
    """
    a, b = F.col(left), F.col(right)
    links = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("l"), b.alias("r")).distinct()
    if ids is None:
        links = cut(links)
        ids = numbered(links.select(F.explode(F.array("l", "r")).alias("id")), "id")
    name = lambda c, n: ids.select(F.col("id").alias(c), F.col("number").alias(n))
    edges = links.join(name("l", "x"), "l").join(name("r", "y"), "r").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    done = cut(star_edges(edges))
    members = done.unionByName(done.select(F.col("v").alias("u"), "v").distinct())
    roots = done.groupBy("v").agg((F.count(F.lit(1)) + 1).alias("n")).join(name("group_id", "v"), "v")
    return lookup(members.join(name("id", "u"), "u").select("id", "v"), roots, ["v"], "n").select("id", "group_id")


def match_groups(pairs: DataFrame) -> DataFrame:
    """(record_id, group_id) for every record id of match_pairs.

    Ids are taken without the blanks around them; null marks are no id. A row links its two ids if its outcome is
    merged, case and blanks aside. A record without a link is its own group. Repeated, turned and half rows are fine.
    """
    p = pairs.select(value_or_null(F.col("left_record")).alias("l"), value_or_null(F.col("right_record")).alias("r"), F.lower(value_or_null(F.col("outcome"))).alias("o"))
    p = cut(p.groupBy("l", "r").agg(F.bool_or(F.coalesce(F.col("o") == "merged", F.lit(False))).alias("linked")))
    ids = numbered(p.select(F.explode(F.array("l", "r")).alias("id")), "id")
    groups = star_components(p.where("linked"), "l", "r", ids)
    return ids.select(F.col("id").alias("record_id")).join(groups.withColumnRenamed("id", "record_id"), "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"))
