"""Every registered query against its SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sillage.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return connection


def plain(value):
    return None if value is None or (isinstance(value, float) and math.isnan(value)) else value


def rows(columns, found):
    order = sorted(columns)
    return sorted((tuple(repr(plain(r[columns.index(c)])) for c in order) for r in found))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    sql = registry.oracles().get(name)
    if sql is None:
        assert found
        return
    relation = duck.sql(sql)
    columns = relation.columns
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, relation.fetchall())


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    made = __spark_entry__.queries()
    assert set(registry.queries()) <= set(made) and set(__spark_entry__.oracle_sql()) <= set(made)
    assert __spark_entry__.entry(spark).count() > 0
