"""Every registered query gives the rows of its SQL, on the smallest standard tables."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the standard tables")


def plain(value):
    if value is None or value != value:
        return None
    return float(f"{float(value):.9g}") if isinstance(value, (float, Decimal)) else str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SMALL).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].values.tolist()), key=str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    keys = [r["claim_key"] for r in entry.entry(spark).collect()]
    assert len(keys) == len(set(keys)) == spark.read.parquet(f"{entry.SMOKE_DIR}/benchmark.parquet").count()
