"""The driver's contract: names, oracles, and results equal to the oracles' on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as e
from textloom.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"annotate_documents", "unspecific_names"}


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, duck, sf, name):
    df = q.QUERIES[name](spark, sf)
    rel = duck.execute(q.ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES) - SLOW))
def test_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
