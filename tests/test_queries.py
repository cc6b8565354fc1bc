"""Every core query against its SQL in DuckDB, on the smallest data; rows only where there is none."""

import os

import duckdb
import pandas as pd
import pytest

from corrobora import queries as core

DATA = os.environ.get("CORROBORA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def shown(v):
    return "<null>" if v is None or (isinstance(v, float) and v != v) or v is pd.NaT else f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    return sorted(tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def compare(spark, duck, query, sql):
    got = query(spark, DATA).toPandas()
    if sql is None:
        assert len(got) and not got.isna().all().all()
    else:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", list(core.queries()))
def test_query(spark, duck, name):
    compare(spark, duck, core.queries()[name], core.oracle_sql().get(name))


def test_years_of_both_tables_of_posts(spark):
    ids = lambda name: {r.record_id for r in core.queries()[name](spark, DATA).select("record_id").distinct().collect()}
    assert ids("years_experience") == ids("p2_found") >= ids("same_job_groups")


@pytest.mark.parametrize("name", ["skill_scan", "country_alias", "guarded_clusters"])
def test_long_alias_tables_raise(spark, monkeypatch, name):
    monkeypatch.setattr(core, "MOST_ALIASES", 100, raising=False)
    with pytest.raises(ValueError, match="more than 100 rows"):
        core.queries()[name](spark, DATA)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and core.queries().keys() <= entry.queries().keys()
