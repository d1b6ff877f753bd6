"""Every registered query against its SQL counterpart on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    yield connection
    connection.close()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        [tuple(row[i] for i in order) for row in values], key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    expected = rows([column[0] for column in result.description], result.fetchall())
    got = rows(frame.columns, [tuple(row) for row in frame.collect()])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    wrong = [pair for pair in zip(got[1], expected[1]) if pair[0] != pair[1]]
    assert not wrong, f"{len(wrong)} rows differ, first: {str(wrong[0])[:2000]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = {column[0]: str(column[1]) for column in result.description}
    assert {column: kinds[kind] for column, kind in frame.dtypes} == types


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 25
