"""Halves are rounded and quantiles interpolated as DuckDB does it, to the bit."""

import duckdb
import numpy as np

from chronogrid import series as S
from chronogrid.functions import kernels as K


def test_halves_round_as_in_sql(spark):
    v = (np.arange(1, 4000) * 7919 % 99991 * 10 + 5) / 1e7
    v = np.concatenate([v, -v, np.nextafter(v, 0), np.nextafter(v, 9), [0.0, -1e-9, 1e300, -1e305, 123456789.0123455]]).tolist()
    got = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").select("i", S.r6("x").alias("x")).orderBy("i").collect()
    want = duckdb.execute("select round(unnest(?::double[]), 6) + 0.0", [v]).fetchall()
    assert [r.x for r in got] == [r[0] for r in want]
    kept = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(S.r6("x").alias("x")).collect()
    assert kept[0].x is None and kept[1].x != kept[1].x and kept[2].x == float("inf")


def test_quantiles_as_in_sql():
    x = np.round(np.random.default_rng(1).integers(0, 120, (400, 83)) / 120, 9)
    n = np.full(len(x), 83.0)
    for q in (0.05, 0.9, 0.95):
        want = [duckdb.execute(f"select quantile_cont(v, {q}) from (select unnest(?::double[]) as v)", [r.tolist()]).fetchall()[0][0] for r in x]
        assert K.quantile(np.sort(x, axis=1), n, q).tolist() == want
    empty = K.quantile(np.full((1, 3), np.nan), np.zeros(1), 0.5)
    assert np.isnan(empty).all()
