"""The registered queries with SQL, over the smallest tables."""

import os

import duckdb
import pytest

from lexengine.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    want = duck.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    found = registry.queries()[name](spark, DATA).select(*columns)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr(tuple(v[i] for i in order)) for v in want.fetchall())


def test_operators():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)}
