"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from veritab.plans import catalogue as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    res = duck.sql(plans.SQL[name])
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    want = sorted(repr([_plain(r[i]) for i in at]) for r in res.fetchall())
    assert got == want
