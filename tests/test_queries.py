"""Every registered query against its SQL, on the same tables."""

import os

import duckdb
import pytest

from workload.queries import QUERIES
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = [tuple(r) for r in frame.select(columns).collect()]
    cursor = sql.execute(oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    at = [list(described).index(c) for c in columns]
    expected = [tuple(row[i] for i in at) for row in cursor.fetchall()]
    assert sorted(described) == columns
    types = [TYPES[frame.schema[c].dataType.simpleString()] for c in columns]
    assert types == [described[c] for c in columns]
    assert ordered(found) == ordered(expected)
    assert found


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = {r["name"]: r["file_count"] for r in entry(spark).collect()}
    assert rows["lineitem"] == 6000 and rows["home"] == 0
