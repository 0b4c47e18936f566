"""Every registered graph query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(names, found):
    return sorted(tuple(map(str, (r[names.index(c)] for c in sorted(names)))) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())
    else:
        assert got.count() >= 1
