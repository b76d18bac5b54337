"""Every query with SQL gives the same rows, names and types as DuckDB."""

from pathlib import Path

import duckdb
import pytest

from stepwell.registry import QUERIES, SQL

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    at = [names.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted((tuple(r[i] for i in at) for r in want), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_enough_queries():
    assert len(SQL) >= 60


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
