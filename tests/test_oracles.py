"""Registered queries against their SQL on DuckDB."""

import os

import duckdb
import pytest

from lattica.plans import catalog

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    plain = lambda x: x.item() if hasattr(x, "item") else x
    return sorted(repr([plain(r[i]) for i in columns]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    res = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = rows([df.columns.index(c) for c in order], [tuple(r) for r in df.collect()])
    assert got == rows([names.index(c) for c in order], res.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
