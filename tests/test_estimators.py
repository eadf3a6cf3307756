"""Hand-checkable series."""

import math

import pytest

from chronogrid.config import Config
from chronogrid.operators import breaks, quality, spectral, trend
from chronogrid.plans.features import GROUPS, feature_names
from chronogrid.series import sealed


def frame(spark, *series):
    rows = [(i, [None if v is None else float(v) for v in s], [100.0 + (7 * t) % 11 for t in range(len(s))]) for i, s in enumerate(series)]
    return spark.createDataFrame(rows, "pixel_id long, ndvi array<double>, rain array<double>")


def one(df):
    return df.collect()[0]


def test_ramp_constant_and_sparse(spark):
    df = frame(spark, [0.3 + 0.01 * t for t in range(36)], [0.5] * 36, [0.5 if t < 5 else None for t in range(36)])
    ramp, flat, few = [r.mk for r in sealed(trend.mann_kendall(df)).orderBy("pixel_id").collect()]
    assert ramp.s > 0 and ramp.p < 0.01 and ramp.tau == 1
    assert (flat.s, flat.z, flat.p, flat["var"]) == (0, 0, 1, None)
    assert few.z is None and few.p is None and few.tau is None


def test_sine_is_periodic(spark):
    assert len(spectral.band(36, Config().cyclicity)) == 7
    for period in (5, 6, 9):
        got = one(spectral.cyclicity(frame(spark, [0.5 + 0.1 * math.sin(2 * math.pi * t / period) for t in range(36)]), 36)).cyc
        assert got.periodic and abs(got.period - period) < 1.2


def test_breaks(spark):
    bent = [0.8 if t < 20 else 0.8 - 0.03 * (t - 20) for t in range(36)]
    got = one(breaks.breakpoint(frame(spark, bent), 36)).brk
    assert abs(got["index"] - 20) <= 2 and got.significant and got.delta_slope < 0
    assert not one(breaks.breakpoint(frame(spark, [0.3 + 0.01 * t for t in range(36)]), 36)).brk.significant
    assert one(breaks.breakpoint(frame(spark, [0.1, 0.5, 0.2, 0.7, 0.1, 0.9, 0.3]), 7)).brk["index"] == -1


def test_recovery_from_a_drop(spark):
    s = [0.75] * 15 + [min(0.75, 0.30 + 0.02 * t) for t in range(21)]
    got = one(breaks.recovery(sealed(breaks.breakpoint(frame(spark, s), 36)), 36)).rec
    assert got.disturbance_magnitude == pytest.approx(0.45, abs=0.12) and got.status in (1, 2)


def test_gaps(spark):
    s = [None] + [0.1 * t for t in range(1, 12)]
    s[4] = None
    for t in (6, 7, 8):
        s[t] = None
    got = one(quality.fill_gaps(frame(spark, s), 12))
    assert got.n_filled == 1 and got.ndvi[4] == pytest.approx(0.4) and got.ndvi[0] is None and got.ndvi[7] is None
    q = one(quality.assess(frame(spark, [None if t % 5 < 3 else 0.1 * (t % 7) for t in range(36)]), 36)).quality
    assert q.flag == quality.TOO_MANY_MISSING


def test_empty_series(spark):
    df = spark.createDataFrame([], "pixel_id long, ndvi array<double>, rain array<double>")
    assert trend.mann_kendall(df).count() == 0 and breaks.breakpoint(df, 36).count() == 0


def test_settings():
    c = Config().override("trend.alpha", "0.1")
    assert c.trend.alpha == 0.1 and Config().trend.alpha == 0.05
    assert Config.from_dict(c.to_dict()) == c
    with pytest.raises(ValueError):
        Config.from_dict({"trend": {"nothing": 1}})
    assert len(feature_names()) == 48 and len(GROUPS) == 8
    with pytest.raises(ValueError):
        feature_names(["nothing"])
