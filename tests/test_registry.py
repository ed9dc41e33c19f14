"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from pageloom.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", list(core.queries()))
def test_core_query(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    found = duck.execute(core.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_contract(spark):
    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
