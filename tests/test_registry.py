"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

from remitta.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "nation customer orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    return "NULL" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    q = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(shown, r)) for r in q.fetchall())
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(5).count() == 5
