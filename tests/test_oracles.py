"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from chronogrid.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    rel = duck.sql(ORACLES[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    want = sorted(([plain(r[at[c]]) for c in cols] for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)), (name, a, b)
    spark.catalog.clearCache()
