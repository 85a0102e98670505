"""Every named query runs on the smallest tables; those with SQL agree with it there."""

import decimal
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
if not os.path.isdir(SF):
    pytest.skip("no test data here", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
from sparkboard.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == names
    ours = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    theirs = sorted(repr([plain(r[order.index(c)]) for c in names]) for r in cur.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
