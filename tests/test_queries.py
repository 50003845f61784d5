"""Every registered catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from catalith import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def normal(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = found.columns
    got = sorted(tuple(map(normal, r)) for r in found.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(registry.ORACLE_SQL[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == sorted(columns)
    assert got == sorted(tuple(normal(row[order.index(c)]) for c in columns) for row in cursor.fetchall())
