"""Each query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from voxelloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted(repr([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_is_its_sql(spark, duck, sf, name):
    got = plans.QUERIES[name](spark, sf)
    want = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLES.keys()))
def test_query_without_sql_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
