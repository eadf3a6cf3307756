"""Experiments, audits, guards, kernels: planted cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogrid.config import Config
from chronogrid.functions import kernels as K
from chronogrid.operators import audits, experiment, ingest, models, tables
from chronogrid.plans.features import GROUPS


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i // 10 % 3), i // 20, i % 20, float(x), float(rng.normal()), None, int(x > 0)) for i, x in enumerate(rng.normal(size=300))]
    return spark.createDataFrame(rows, "pixel_id long, fold int, row int, col int, good double, noise double, blank double, label int")


def test_importance_finds_the_planted_column(samples):
    cfg = Config().override("forest.n_trees", 20).forest
    got = {r.feature: r for r in experiment.importance_summary(experiment.permutation_importance(samples, ["good", "noise", "blank"], "label", 3, cfg, 2)).collect()}
    assert got["good"].importance_mean > 0.3 > abs(got["noise"].importance_mean) and got["blank"].importance_mean == 0 and got["good"].n_folds == 3


def test_random_baseline_and_impurity(samples):
    cfg = Config().override("forest.n_trees", 20).forest
    got = experiment.random_baseline(samples, ["good", "noise"], "label", cfg).collect()
    assert 88 <= len(got) <= 92 and sum(r.truth == r.prediction for r in got) >= 0.9 * len(got)
    fitted = models.fit_forest(samples.withColumn("label", F.col("label").cast("double")), ["good", "blank"], "label", cfg)
    assert fitted.impurity["good"] > 0.9 and fitted.impurity["blank"] == 0


def test_holdout_predicts_the_future_label(samples):
    cfg = Config().override("forest.n_trees", 20).forest
    future = samples.select("pixel_id", (1 - F.col("label")).alias("label"))
    got = experiment.holdout_predictions(samples, future, ["good"], "label", 3, cfg).collect()
    assert len(got) == 300 and sum(r.truth == r.prediction for r in got) >= 280


def test_ablation_cells_are_nested():
    have = [{f for g in groups for f in GROUPS[g]} for _, _, groups in experiment.CELLS]
    assert all(a < b for a, b in zip(have, have[1:])) and len(have[-1]) == 46
    a = experiment.experiment_id("A", ["x", "y"], {"trees": 5})
    assert a == experiment.experiment_id("A", ["y", "x"], {"trees": 5}) != experiment.experiment_id("A", ["x", "y"], {"trees": 6})


def test_strict_audit_raises(spark):
    steps = spark.createDataFrame([("history", 1), ("future", 2)], "part string, t int")
    assert audits.report(audits.temporal_separation(steps, 2)).first().passed
    with pytest.raises(audits.LeakageError, match="temporal_separation"):
        audits.report(audits.temporal_separation(steps, 1))
    assert not audits.temporal_separation(steps.where("t = 1"), 2).first().passed


@pytest.mark.parametrize("text", ["", None, "derived from NDVI", "my model"])
def test_circular_labels_are_refused(text):
    with pytest.raises(ValueError):
        audits.guard_provenance(text)


def test_independent_labels_pass():
    assert audits.guard_provenance("field") == "field"


def test_scene_index_guards(spark):
    rows = [("LANDSAT8_OLI", 8000, 9000, 12000, 5000, 0, 0)]
    kind = "sensor string, blue int, red int, nir int, swir1 int, qa int, radsat int"
    ok = spark.createDataFrame(rows, kind)
    red, nir, blue = (v * 2.75e-05 - 0.2 for v in (9000, 12000, 8000))
    evi = 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1)
    assert ingest.scene_index(ok, "evi").first().value == pytest.approx(0.9589 * evi + 0.0029)
    assert ingest.scene_index(ok, "evi").first().nir == pytest.approx(nir)
    for bad in ([("UNKNOWN", 8000, 9000, 12000, 5000, 0, 0)], [("LANDSAT8_OLI", 8000, 9000, 12000, 5000, None, 0)]):
        with pytest.raises(Exception, match="sensor"):
            ingest.scene_index(spark.createDataFrame(bad, kind)).collect()
    with pytest.raises(ValueError, match="swir2"):
        ingest.scene_index(ok, "nbr")


def test_crop_without_overlap_raises(spark):
    with pytest.raises(ValueError, match="overlap"):
        tables.crop(spark.range(1).selectExpr("0 as row", "0 as col"), (0, 0, 1, 1), 90.0, 26.0, 0.1, 50, 40)


def test_surrogate_nulls(spark):
    t = np.arange(40)
    series = spark.createDataFrame([(1, np.sin(2 * np.pi * t / 8).tolist()), (2, np.random.default_rng(1).normal(size=40).tolist())], "pixel_id long, ndvi array<double>")
    got = {r.pixel_id: r.significant for r in models.surrogate_test(series, 40, null="shuffle").collect()}
    assert got[1] and not got[2]
    with pytest.raises(ValueError, match="null"):
        models.surrogate_test(series, 40, null="white")


def test_settings_are_checked():
    c = Config.from_dict({"trend": {"alpha": 0.1, "_note": "x"}})
    assert c.trend.alpha == 0.1 and Config().trend.alpha == 0.05 and Config.from_dict(c.to_dict()) == c
    for bad in ({"trend": {"alpha": 2}}, {"trend": {"beta": 1}}, {"nothing": {}}, {"restrend": {"method": "three"}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)


def test_kernels_against_loops():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 25)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[0], x[1] = np.nan, 3.0
    mk = K.mann_kendall(x, 10, True)
    for k, row in enumerate(x):
        seen = [(i, v) for i, v in enumerate(row) if v == v]
        pairs = [(a, b) for n, a in enumerate(seen) for b in seen[n + 1 :]]
        assert mk["s"][k] == sum(np.sign(b[1] - a[1]) for a, b in pairs)
        if len(seen) >= 10:
            assert mk["sen"][k] == pytest.approx(np.median([(b[1] - a[1]) / (b[0] - a[0]) for a, b in pairs]))
    brk = K.breakpoint(x, 4, 0.05, 0.05, True)
    for k, row in enumerate(x):
        best = (np.inf, -1)
        for cut in range(4, 21):
            total = 0.0
            for part in (np.arange(25) < cut, np.arange(25) >= cut):
                m = part & ~np.isnan(row)
                if m.sum() < 4:
                    total = np.inf
                    break
                total += np.square(row[m] - np.polyval(np.polyfit(np.flatnonzero(m), row[m], 1), np.flatnonzero(m))).sum()
            if total < best[0] - 1e-9:
                best = (total, cut)
        if np.isfinite(best[0]) and k != 1:
            assert brk["index"][k] == best[1]
    p = K.student_two_sided(np.array([2.0, 2.0, np.nan]), np.array([10.0, 7.0, 3.0]))
    at = np.linspace(-2, 2, 400_001)
    for k, df in enumerate((10, 7)):
        density = (1 + at * at / df) ** (-(df + 1) / 2)
        tails = np.linspace(-4000, 4000, 8_000_001)
        whole = (1 + tails * tails / df) ** (-(df + 1) / 2)
        assert p[k] == pytest.approx(1 - np.trapezoid(density, at) / np.trapezoid(whole, tails), abs=1e-6)
    assert np.isnan(p[2])


def test_sql_functions(spark):
    from chronogrid.functions import sql

    assert "sens_slope" in sql.register(spark)
    spark.createDataFrame([(1, [float(2 * i) for i in range(12)]), (2, None), (3, [1.0, None] * 6)], "id int, x array<double>").createOrReplaceTempView("series_in")
    got = {r.id: r for r in spark.sql("select id, sens_slope(x) as s, mk_s(x) as k, series_corr(x, x) as c from series_in").collect()}
    assert got[1].s == 2 and got[1].k == 66 and got[1].c == pytest.approx(1) and got[2].s is None and got[3].k == 0


def test_regions_and_alignment(spark):
    from chronogrid.operators import spatial

    rows = [(0, c, 1) for c in range(30)] + [(r, 29, 1) for r in range(1, 20)] + [(19, c, 1) for c in range(10)] + [(5, 5, 2)]
    cells = spark.createDataFrame(rows, "row int, col int, class int")
    got = {(r.row, r.col): (r.region_row, r.region_col) for r in spatial.connected_regions(cells, "class").collect()}
    assert got[19, 29] == (0, 0) and got[19, 5] == (19, 0) and got[5, 5] == (5, 5) and len(got) == len(rows)
    grid = {"crs": "x", "a": 0.1, "b": 0.0, "c": 90.0, "d": 0.0, "e": -0.1, "f": 26.0, "height": 50, "width": 40}
    spatial.require_alignment(grid, dict(grid))
    with pytest.raises(ValueError, match="origin"):
        spatial.require_alignment(grid, grid | {"c": 90.05})
    with pytest.raises(ValueError):
        spatial.align_to_reference(cells, cells, 1.0, 0.0, "other")


def test_buffer_separation_and_too_few_blocks(spark):
    from chronogrid.operators import spatial

    rng = np.random.default_rng(2)
    spots = [(int(a), int(b), 0) for a, b in rng.integers(0, 20, (5, 2))] + [(int(a) + 45, int(b), 1) for a, b in rng.integers(0, 20, (5, 2))]
    df = spark.createDataFrame(spots, "block_row int, block_col int, fold int")
    want = min(max(abs(a - c), abs(b - d)) for a, b, f in spots for c, d, g in spots if f == 0 and g == 1)
    assert spatial.buffer_separation(df, 0).first()[0] == want
    with pytest.raises(ValueError, match="fewer blocks"):
        spatial.block_folds(spark.createDataFrame([(0, 0, 0)], "pixel_id long, row int, col int"), 2, 10, 3)
