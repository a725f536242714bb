"""Every registered query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lexengine import catalogue

DATA = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order) for v in values], key=repr)


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in os.listdir(DATA):
        found.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return found


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "category"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
