"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import numbers

import duckdb
import pytest

from lanewise.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, (str, bool, datetime.date)):
        return str(value)
    return f"{float(value):.4f}" if not isinstance(value, numbers.Integral) else f"{int(value)}.0000"


def compare(spark, duck, query, sql):
    found, expected = query(spark, SF), duck.sql(sql)
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    compare(spark, duck, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
