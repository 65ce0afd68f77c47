"""Every catalogue query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from vigil.plans.catalog import QUERIES
from vigil.plans.check import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["origin_country", "n"] and df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(QUERIES) & set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert canon(rows, cols) == canon(cur.fetchall(), dcols)
