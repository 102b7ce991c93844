"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalogue as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [*plans.SQL])
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    relation = duck.sql(plans.SQL[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.SQL])
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0
