"""The surrogate test and the forest."""

import math

import numpy as np

from chronogrid.config import Config
from chronogrid.operators.models import spatial_cv, surrogate_test


def test_surrogates(spark):
    rng = np.random.default_rng(0)
    rows = [(0, [math.sin(2 * math.pi * t / 6) for t in range(36)])] + [(i, rng.normal(size=36).tolist()) for i in range(1, 61)] + [(99, [None] * 36)]
    got = {r.pixel_id: r for r in surrogate_test(spark.createDataFrame(rows, "pixel_id long, ndvi array<double>"), 36).collect()}
    assert got[0].significant and got[99].p_value is None
    assert sum(got[i].significant for i in range(1, 61)) <= 9


def test_forest(spark):
    rows = [(i, i % 3, float(i % 2), i % 2, None) for i in range(90)]
    df = spark.createDataFrame(rows, "pixel_id long, fold int, a double, label int, b double")
    got = spatial_cv(df, ["a", "b"], "label", 3, Config().override("forest.n_trees", 5).forest)
    assert got.count() == 90 and got.where("truth = prediction").count() == 90
