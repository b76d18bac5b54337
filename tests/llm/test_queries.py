"""Registered queries: names, SQL parity, whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(spark, sf, n):
    (name,) = [q for q in entry.queries() if q.startswith(f"op{n}_")]
    rows = entry.queries()[name](spark, sf).count()
    table = "pages" if n == 2 else "documents"
    if n not in (3, 10):
        assert rows == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_dedup_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["op8_exact_dedup"]).fetchall())
    assert sorted(map(tuple, entry.queries()["op8_exact_dedup"](spark, sf).collect())) == want
