"""Every registered query of the shelf engine against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tallyshelf.plans import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(list(map(plain, v))) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="session")
def views(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, views, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        assert found
        return
    got = views.sql(registry.ORACLES[name])
    assert sorted(got.columns) == cols
    at = [got.columns.index(c) for c in cols]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
