"""Every registered booking query against its SQL counterpart on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SMALL
from wayledger.plans.oracle import oracle
from wayledger.plans.registry import QUERIES

ORACLE = oracle()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("orders", "lineitem"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, duck, small, name):
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    expected = [dict(zip(columns, row)) for row in cursor.fetchall()]
    table = QUERIES[name](spark, small)
    found = [row.asDict() for row in table.collect()]
    assert sorted(table.columns) == sorted(columns)

    def ordered(rows):
        return sorted((tuple(row[c] for c in sorted(columns)) for row in rows), key=str)

    assert ordered(found) == ordered(expected)
    assert found


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
