from pyspark.sql import functions as F

from corrobora.operators.components import min_label_components
from corrobora.operators.skew import lookup
from corrobora.session import checkpoint_dir, cut, drop_cut


def test_lookup_equals_a_join_with_hot_null_and_missing_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("k IS NULL OR k <> 'k5'")
    got = {(r.id, r.k, r.low) for r in lookup(rows, keyed, ["k"], "n").collect()}
    want = {(r.id, r.k, r.low) for r in rows.join(keyed.drop("n"), "k", "left").select("id", "k", "low").collect()}
    assert got == want and len(got) == 3000
    inner = lookup(rows, keyed, ["k"], "n", how="inner")
    assert inner.count() == rows.join(keyed, "k").count()


def test_components(spark):
    chain = [(f"r{i:03d}", f"h{i}") for i in range(40)] + [(f"r{i + 1:03d}", f"h{i}") for i in range(40)]
    hub = [(f"s{i:04d}", "hub") for i in range(1500)]
    df = spark.createDataFrame([*chain, *hub, ("alone", "x"), (None, "hub"), ("t", None)], "node string, hub string")
    got = {r.node: r.component for r in min_label_components(df, "node", "hub").collect()}
    assert len(got) == 41 + 1500 + 1
    assert {got[n] for n, _ in chain} == {"r000"} and {got[n] for n, _ in hub} == {"s0000"} and got["alone"] == "alone"
    assert min_label_components(df.limit(0), "node", "hub").count() == 0


def test_cut_tables_lie_in_the_checkpoint_folder(spark, tmp_path, monkeypatch):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    monkeypatch.setattr("corrobora.session.checkpoint_dir", lambda s: str(tmp_path))
    first = cut(spark.range(5).select("id", F.lit(None).cast("string").alias("x y"), F.array(F.struct("id")).alias("a")))
    assert [r[0] for r in first.orderBy("id").collect()] == list(range(5)) and list(tmp_path.rglob("*.parquet"))
    second = cut(first.where("id > 2"), instead_of=first)
    assert second.count() == 2 and len({p.parent for p in tmp_path.rglob("*.parquet")}) == 1
    drop_cut(second)
    drop_cut(spark.range(1))
    assert not list(tmp_path.rglob("*.parquet"))
    assert cut(spark.range(0)).count() == 0
