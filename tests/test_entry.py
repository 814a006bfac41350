"""Every query runs at the smallest scale; those with SQL give the same rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return f"{float(x):.6g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.sql(entry.oracle_sql()[name])
    at = {c: i for i, c in enumerate(found.columns)}
    assert sorted(at) == cols
    rows = df.collect()
    assert rows, "equal to nothing proves nothing"
    assert sorted([plain(r[c]) for c in cols] for r in rows) == sorted([plain(r[at[c]]) for c in cols] for r in found.fetchall())
