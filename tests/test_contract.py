"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.count() > 0 and "segment_id" in result.columns


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_equals_sql(spark, tables, name):
    result = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in result.collect())
    if name not in entry_module.oracle_sql():
        assert got
        return
    answer = tables.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(_plain(float(row[i]) if type(row[i]).__name__ == "Decimal" else row[i]) for i in at)) for row in answer.fetchall())
    assert got == expected
