"""Queries of the experiment layer, the audits and the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import series as S
from ..operators import audits, breaks, experiment, ingest, models, spatial, tables, trend
from . import demo
from . import oracle_parts as O
from .features import GROUPS, feature_names
from .queries import CONF, FT83, REFL, SUP, USR, add, cols

# The columns of the first, smaller feature block.
BLOCK = "mean std cv amp sen mk_z restrend cyc_score cyc_enrichment cyc_period has_break break_t break_dslope break_gain has_disturbance recovery_fraction recovery_slope disturbance_magnitude".split()

for _name, (_num, _den) in ingest.INDICES.items():
    if _name != "ndvi":
        _n, _d = _num.replace("D", ""), _den.replace("D", "")
        _v = f"gain * CASE WHEN (qa & 63) = 0 AND radsat = 0 AND abs({_d}) >= 1e-10 AND ({_n}) / ({_d}) BETWEEN -1 AND 1 THEN ({_n}) / ({_d}) END + bias"
        add(f"scene_index_{_name}", f"WITH {REFL} SELECT scene_id, {cols(value=_v)} FROM refl WHERE sensor <> 'SENTINEL2_MSI'")(
            lambda s, d, n=_name: ingest.scene_index(demo.scenes(s, d).where("sensor <> 'SENTINEL2_MSI'"), n).select("scene_id", "value")
        )
add("rain_nodata", "SELECT l_orderkey, l_linenumber, " + cols(rain="CASE WHEN l_quantity - 10000 > -9998 THEN l_quantity - 10000 END") + " FROM lineitem")(
    lambda s, d: ingest.clean_rain(S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 10000).cast("double").alias("rain")))
)
add("index_bands", "SELECT * FROM (VALUES ('ndvi', 2), ('evi', 3), ('nbr', 2), ('ndmi', 2)) v(index, n_bands)")(lambda s, d: ingest.describe_indices(s).select("index", F.size("bands").alias("n_bands")))
add("degradation_label", f"WITH {demo.PREDICTIONS_SQL} SELECT (truth + prediction IN (4))::INTEGER AS degraded, count(*) AS n FROM pr GROUP BY 1")(
    lambda s, d: demo.predictions(s, d).groupBy(experiment.degradation_label(F.col("truth") + F.col("prediction")).alias("degraded")).agg(F.count(F.lit(1)).alias("n"))
)
add("block_features", f"WITH {FT83} SELECT pixel_id, {cols(**{c: c for c in BLOCK})} FROM ft")(lambda s, d: demo.supplier_features(s, d).select("pixel_id", *BLOCK))
add("sen_line", f"""WITH {SUP}, m AS (SELECT pixel_id, median(x) AS mx, median(t) AS mt FROM s WHERE x IS NOT NULL GROUP BY 1), sl AS (SELECT a.pixel_id, median((b.x - a.x) / (b.t - a.t)) AS sen FROM s a JOIN s b ON a.pixel_id = b.pixel_id AND a.t < b.t WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1)
SELECT s.pixel_id, s.t::INTEGER AS t, {cols(line='mx + sen * (s.t - mt)')} FROM s LEFT JOIN m USING (pixel_id) LEFT JOIN sl USING (pixel_id)""")(
    lambda s, d: trend.sen_line(S.supplier_months(s, d)).select("pixel_id", F.posexplode("line").alias("t", "line"))
)
add("restrend_residuals", f"""WITH {SUP}, v AS (SELECT * FROM s WHERE x IS NOT NULL AND r IS NOT NULL), a AS (SELECT pixel_id, avg(x) AS mx, avg(r) AS mr, avg(t) AS mt, var_pop(r) AS rr, var_pop(t) AS tt, covar_pop(r, t) AS rt, covar_pop(r, x) AS rx, covar_pop(t, x) AS tx FROM v GROUP BY 1 HAVING count(*) >= 4)
SELECT s.pixel_id, s.t::INTEGER AS t, {cols(residual='x - mx - (tt * rx - rt * tx) / (rr * tt - rt * rt) * (r - mr) - (rr * tx - rt * rx) / (rr * tt - rt * rt) * (t - mt)')} FROM s LEFT JOIN a USING (pixel_id)""")(
    lambda s, d: trend.restrend_residuals(S.supplier_months(s, d)).select("pixel_id", F.posexplode_outer("residual").alias("t", "residual"))
)
add("pixel_map", f"WITH {USR} SELECT pixel_id, {cols(mean='avg(x)', std='stddev_pop(x)')}, count(x) AS n_valid FROM s GROUP BY 1")(lambda s, d: tables.pixel_map(S.to_long(S.user_days(s, d))))
_CLASS = "CASE WHEN coalesce(mk_p_value < 0.05, false) AND sen > 0 THEN 'significant_increase' WHEN coalesce(mk_p_value < 0.05, false) AND sen < 0 THEN 'significant_decrease' WHEN NOT coalesce(mk_p_value < 0.05, false) THEN 'no_significant_trend' END"
add("trend_areas", f"WITH {FT83}, tc AS (SELECT {_CLASS} AS class, sen FROM ft) SELECT class, count(*) AS n_pixels, {cols(area_km2='count(*) * 0.09::DOUBLE', fraction='count(*) / (SELECT count(*) FROM tc WHERE class IS NOT NULL)', median_sen='median(sen)')} FROM tc WHERE class IS NOT NULL GROUP BY 1")(
    lambda s, d: tables.trend_areas(demo.supplier_features(s, d), 0.09)
)
_Q = ["mean", "sen", "restrend_r2", "cyc_enrichment", "break_gain", "recovery_fraction"]
add("feature_quality", f"WITH {FT83}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM ft" for c in _Q) + f") SELECT feature, count(v) AS n_finite, {cols(missing_fraction='1 - count(v) / count(*)', mean='avg(v)', std='stddev_samp(v)', min='min(v)', p25='quantile_cont(v, 0.25)', median='median(v)', p75='quantile_cont(v, 0.75)', max='max(v)')} FROM u GROUP BY 1")(
    lambda s, d: tables.feature_quality(demo.supplier_features(s, d), _Q)
)
add("recovery_areas", f"WITH {FT83}, names(status, name) AS (VALUES {', '.join(f'({k}, {chr(39)}{v}{chr(39)})' for k, v in breaks.STATUS_NAMES.items())}) SELECT names.status::INTEGER AS status, name, count(ft.pixel_id) AS n_pixels, {cols(area_km2='count(ft.pixel_id) * 0.09::DOUBLE')} FROM names LEFT JOIN ft ON recovery_status = names.status GROUP BY 1, 2")(
    lambda s, d: tables.status_areas(demo.supplier_features(s, d), breaks.STATUS_NAMES, 0.09, "recovery_status")
)
add("method_comparison", f"WITH {demo.METHODS_SQL} SELECT truth, method, count(*) AS n_pixels, {cols(pct_flagged='100 * avg(flagged::INTEGER)')} FROM mf GROUP BY 1, 2")(lambda s, d: tables.method_comparison(demo.method_flags(s, d)))
add("confounder_rates", f"WITH {CONF} SELECT method, {cols(fpr_0='max(k / n) FILTER (truth = 0)', fpr_1='max(k / n) FILTER (truth = 1)')} FROM cf GROUP BY 1")(lambda s, d: tables.confounder_rates(demo.method_flags(s, d), [2, 3], [0, 1, 2, 3]))
add("sensor_year_counts", f"WITH {demo.SCENES_SQL} SELECT sensor, year(obs_date)::INTEGER AS year, count(*) AS n_scenes FROM sc GROUP BY 1, 2")(lambda s, d: tables.sensor_year_counts(demo.scenes(s, d)))


def _month_scenes(s: SparkSession, d: str) -> DataFrame:
    """Months of a sensor as scenes: the mean index of each pixel."""
    ob = demo.observations(s, d).withColumn("scene_id", F.concat_ws(":", "sensor", F.date_format("obs_date", "yyyy-MM")))
    return ob.groupBy("scene_id", "sensor", F.trunc("obs_date", "month").alias("obs_date"), "pixel_id").agg(F.avg("value").alias("value"))


def _differences(s: SparkSession, d: str) -> DataFrame:
    cells = _month_scenes(s, d)
    scene = cells.select("scene_id", "sensor", "obs_date").distinct()
    pairs = scene.where("sensor = 'LANDSAT8_OLI'").select(F.col("scene_id").alias("left_id"), "obs_date").join(scene.where("sensor = 'LANDSAT7_ETM'").select(F.col("scene_id").alias("right_id"), "obs_date"), "obs_date")
    return tables.paired_differences(pairs, cells, 3)


_DIFF = f"""{demo.OBSERVATIONS_SQL}, mc AS (SELECT sensor || ':' || strftime(obs_date, '%Y-%m') AS scene_id, sensor, date_trunc('month', obs_date) AS m, pixel_id, avg(value) AS v FROM ob GROUP BY 1, 2, 3, 4
), pd AS (SELECT a.scene_id AS left_id, b.scene_id AS right_id, count(*) AS n_common, median(a.v - b.v) AS md FROM mc a JOIN mc b ON a.m = b.m AND a.pixel_id = b.pixel_id AND a.sensor = 'LANDSAT8_OLI' AND b.sensor = 'LANDSAT7_ETM' WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"""
add("paired_differences", f"WITH {_DIFF} SELECT left_id, right_id, n_common, {cols(median_difference='md')} FROM pd")(_differences)
add("pooled_difference", f"WITH {_DIFF} SELECT count(*) AS n_pairs, {cols(pooled_median='sum(md * n_common) / sum(n_common)', mean_of_medians='avg(md)', sd_of_medians='stddev_samp(md)')} FROM pd")(lambda s, d: tables.pooled_difference(_differences(s, d)))
add("attach_labels", f"WITH {demo.CELLS_SQL} SELECT pixel_id, CASE WHEN pixel_id % 3 = 0 AND pixel_id % 5 <> 0 THEN (pixel_id % 7)::INTEGER END AS label FROM ce")(
    lambda s, d: tables.attach_labels(demo.grid_cells(s, d), demo.grid_cells(s, d).where("pixel_id % 3 = 0").selectExpr("row", "col", "cast(if(pixel_id % 5 = 0, -1, pixel_id % 7) as int) as label")).select("pixel_id", "label")
)
add("crop", f"WITH {demo.CELLS_SQL} SELECT pixel_id FROM ce WHERE row BETWEEN 4 AND 30 AND col BETWEEN 11 AND 25")(lambda s, d: tables.crop(demo.grid_cells(s, d), (91.15, 22.95, 92.55, 25.55), 90.0, 26.0, 0.1, 50, 40).select("pixel_id"))
_D, _U = "mk_p_value < 0.05 AND sen < 0", "mk_p_value < 0.05 AND sen > 0"
_RES = {
    "pixels": "count(*)", "area_km2": "count(*) * 0.09", "mean_ndvi": "avg(mean)", "median_sen": "median(sen)", "declining_pixels": f"count(*) FILTER ({_D})", "rising_pixels": f"count(*) FILTER ({_U})",
    "declining_km2": f"count(*) FILTER ({_D}) * 0.09", "rising_km2": f"count(*) FILTER ({_U}) * 0.09", "restrend_valid_pixels": "count(*) FILTER (restrend_valid = 1)", "restrend_declining_pixels": "count(*) FILTER (restrend_significant = 1 AND restrend < 0)",
    "mean_restrend_r2": "avg(restrend_r2)", "periodic_pixels": "count(*) FILTER (cyclicity_periodic = 1)", "mean_enrichment": "avg(cyc_enrichment)", "break_pixels": "count(*) FILTER (has_break = 1)", "significant_break_pixels": "count(*) FILTER (breakpoint_significant = 1)",
    "disturbed_pixels": "count(*) FILTER (has_disturbance = 1)", "recovered_pixels": "count(*) FILTER (recovery_status = 1)", "recovering_pixels": "count(*) FILTER (recovery_status = 2)", "mean_valid_steps": "avg(n_valid_ndvi)", "mean_rain": "avg(rain_mean)", "mean_correlation": "avg(rain_ndvi_correlation)",
}
add("results_table", f"WITH {FT83}, a AS (SELECT {', '.join(f'({e})::DOUBLE AS {k}' for k, e in _RES.items())} FROM ft) SELECT quantity, {cols(value='v')} FROM (UNPIVOT a ON COLUMNS(*) INTO NAME quantity VALUE v)")(
    lambda s, d: tables.results_table(demo.supplier_features(s, d), 0.09)
)

add("connected_regions", f"""WITH RECURSIVE {demo.CELLS_SQL}, lc AS (SELECT row, col, floor(value / 250)::INTEGER AS class FROM ce WHERE value IS NOT NULL
), rg(row, col, class, a, b) AS (SELECT row, col, class, row, col FROM lc UNION SELECT n.row, n.col, n.class, rg.a, rg.b FROM rg JOIN lc n ON n.class = rg.class AND abs(n.row - rg.row) + abs(n.col - rg.col) = 1)
SELECT row, col, class, min((a, b))[1] AS region_row, min((a, b))[2] AS region_col FROM rg GROUP BY 1, 2, 3""")(
    lambda s, d: spatial.connected_regions(demo.grid_cells(s, d).withColumn("class", F.expr("cast(floor(value / 250) as int)")), "class")
)

# ---------------------------------------------------------------- experiments

add("ablation_cells", "SELECT * FROM (VALUES ('A', 'A_basic_vegetation', 9), ('B', 'B_basic_trend', 14), ('C', 'C_add_restrend', 20), ('D', 'D_add_cyclicity', 26), ('E', 'E_add_disturbance', 41), ('F', 'F_full', 46)) v(experiment, name, n_features)")(
    lambda s, d: experiment.cell_features(s, GROUPS).groupBy("experiment", "name").agg(F.count_distinct("feature").cast("int").alias("n_features"))
)
add("random_split", f"WITH {demo.PREDICTIONS_SQL} SELECT pixel_id, truth, row_number() OVER (PARTITION BY truth ORDER BY md5('42:' || pixel_id), pixel_id) <= ceil(count(*) OVER (PARTITION BY truth) * 0.3) AS test FROM pr")(
    lambda s, d: experiment.random_split(demo.predictions(s, d).select("pixel_id", "truth"), "truth")
)
add("validation_folds", f"WITH {demo.PREDICTIONS_SQL}, f AS (SELECT DISTINCT fold FROM pr) SELECT test_fold, validation_fold FROM (SELECT a.fold AS test_fold, b.fold AS validation_fold, row_number() OVER (PARTITION BY a.fold ORDER BY md5((42 + a.fold) || ':' || b.fold), b.fold) AS r FROM f a JOIN f b ON a.fold <> b.fold) WHERE r <= 2")(
    lambda s, d: experiment.validation_folds(demo.predictions(s, d), 2)
)
add("permuted_column", f"WITH {demo.PREDICTIONS_SQL}, o AS (SELECT pixel_id, fold, row_number() OVER (PARTITION BY fold ORDER BY pixel_id) AS r FROM pr), n AS (SELECT fold, prediction, row_number() OVER (PARTITION BY fold ORDER BY md5('42:' || pixel_id), pixel_id) AS r FROM pr) SELECT pixel_id, fold, n.prediction FROM o JOIN n USING (fold, r)")(
    lambda s, d: experiment.permuted(demo.predictions(s, d).select("pixel_id", "fold", "prediction"), "prediction", "fold")
)
_IMP = "im AS (SELECT 'f' || (l_suppkey % 9) AS feature, l_linenumber AS fold, avg(l_discount) AS importance FROM lineitem GROUP BY 1, 2), su AS (SELECT feature, avg(importance) AS m, coalesce(stddev_samp(importance), 0) AS sd, count(DISTINCT fold) AS n FROM im GROUP BY 1)"


def _importance(s: SparkSession, d: str) -> DataFrame:
    rows = S.table(s, d, "lineitem").groupBy(F.expr("concat('f', l_suppkey % 9)").alias("feature"), F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("importance"))
    return experiment.importance_summary(rows)


def _impurity(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "lineitem").where("l_suppkey % 9 <> 3").groupBy(F.expr("concat('f', l_suppkey % 9)").alias("feature")).agg(F.round(F.avg("l_tax"), 3).alias("importance"))


add("importance_summary", f"WITH {_IMP} SELECT feature, {cols(importance_mean='m', importance_std='sd')}, n AS n_folds FROM su")(_importance)
add("top_features", f"WITH {_IMP} SELECT feature, {cols(importance_mean='m', importance_std='sd')}, n AS n_folds FROM su ORDER BY m DESC, feature LIMIT 3")(lambda s, d: experiment.top_features(_importance(s, d), 3))
add("importance_comparison", f"""WITH {_IMP}, py AS (SELECT 'f' || (l_suppkey % 9) AS feature, round(avg(l_tax), 3) AS v FROM lineitem WHERE l_suppkey % 9 <> 3 GROUP BY 1), j AS (SELECT feature, m, v FROM su LEFT JOIN py USING (feature))
SELECT feature, {cols(permutation='m', impurity='v', rank_permutation='(SELECT count(*) FROM j k WHERE k.m > j.m) + ((SELECT count(*) FROM j k WHERE k.m = j.m) + 1) / 2.0', rank_impurity='CASE WHEN v IS NOT NULL THEN (SELECT count(*) FROM j k WHERE k.v > j.v) + ((SELECT count(*) FROM j k WHERE k.v = j.v) + 1) / 2.0 END')} FROM j""")(
    lambda s, d: experiment.importance_comparison(_importance(s, d), _impurity(s, d))
)
_SC = f"""{demo.METHODS_SQL}, fl AS (SELECT method, pixel_id, fold, truth >= 2 AS t, flagged AS p FROM mf JOIN (SELECT pixel_id, any_value(fold) AS fold FROM pr GROUP BY 1) USING (pixel_id) WHERE pixel_id IN (SELECT pixel_id FROM mf WHERE evaluated GROUP BY 1 HAVING count(*) = 3)"""


def _binary(s: SparkSession, d: str) -> DataFrame:
    flags = demo.method_flags(s, d)
    return flags.withColumns({"truth": F.expr("cast(truth >= 2 as int)"), "prediction": F.col("flagged").cast("int")})


_F1 = "(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2"
_MX = f"{_SC}), mm AS (SELECT method, count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM fl GROUP BY 1)"
add("matrix_scores", f"WITH {_MX} SELECT method, n AS n_samples, {cols(accuracy='(tp + tn) / n', f1_macro=_F1)} FROM mm")(lambda s, d: experiment.matrix_scores(_binary(s, d)))


def _conclusion(s: SparkSession, d: str) -> DataFrame:
    scores = experiment.matrix_scores(_binary(s, d))
    spread = demo.method_flags(s, d).withColumn("fold", F.expr("pixel_id % 5")).groupBy("method", "fold").agg(F.avg(F.expr("cast(flagged as int)")).alias("v")).groupBy("method").agg(F.stddev_pop("v").alias("fold_std"))
    return experiment.conclusion(scores.join(spread, "method"), "c")


add("conclusion", f"""WITH {_MX}, sp AS (SELECT method, stddev_pop(v) AS fs FROM (SELECT method, pixel_id % 5 AS f, avg(flagged::INTEGER) AS v FROM mf GROUP BY 1, 2) GROUP BY 1), sc AS (SELECT method, {_F1} AS f1, fs FROM mm JOIN sp USING (method)), b AS (SELECT * FROM sc ORDER BY f1 DESC, method DESC LIMIT 1), z AS (SELECT * FROM sc WHERE method = 'c')
SELECT b.method AS best_method, {cols(best_f1_macro='b.f1', baseline_f1_macro='z.f1', improvement='b.f1 - z.f1', fold_spread='greatest(b.fs, z.fs)')}, abs(b.f1 - z.f1) > greatest(b.fs, z.fs) AS exceeds_spread FROM b CROSS JOIN z""")(_conclusion)

# ---------------------------------------------------------------- audits


def _audit(s: SparkSession, d: str) -> DataFrame:
    rows = demo.predictions(s, d)
    steps = S.to_long(S.user_days(s, d)).select(F.expr("if(t < 19, 'history', 'future')").alias("part"), "t")
    groups = s.createDataFrame([(g, f) for g, fs in GROUPS.items() for f in fs], "grp string, feature string")
    cells = experiment.cell_features(s, GROUPS)
    declared = s.createDataFrame([(k, g) for k, _, gs in experiment.CELLS for g in gs], "experiment string, grp string")
    wrong = cells.where("not (experiment = 'B' and feature = 'mk_z')").union(s.createDataFrame([("A", "x", "rain_mean")], cells.schema))
    return audits.report(
        audits.temporal_separation(steps, 19), audits.temporal_separation(steps, 18).withColumn("check", F.lit("temporal_late")),
        audits.preprocessing_isolation(rows.where("fold < 3"), rows.where("fold >= 2")), audits.ablation_isolation(cells, groups), audits.group_match(cells, declared, groups),
        audits.group_match(wrong, declared, groups).withColumn("check", F.lit("group_mismatch")), strict=False,
    )


add("audit_report", f"""WITH {USR}, {demo.PREDICTIONS_SQL}, a(c, n) AS (
  SELECT 'temporal_separation', count(*) FILTER ((t < 19) <> (t < 19)) FROM s UNION ALL SELECT 'temporal_late', count(*) FILTER ((t < 19) <> (t < 18)) FROM s
  UNION ALL SELECT 'preprocessing_isolation', count(*) FROM (SELECT pixel_id FROM pr WHERE fold < 3 INTERSECT SELECT pixel_id FROM pr WHERE fold >= 2)
  UNION ALL VALUES ('ablation_isolation', 0), ('ablation_feature_groups', 0), ('group_mismatch', 2)
) SELECT c AS "check", n = 0 AS passed, n::BIGINT AS n FROM a""")(_audit)

# ---------------------------------------------------------------- without SQL: fitted models and whole recomputation


def _samples(s: SparkSession, d: str) -> DataFrame:
    placed = demo.supplier_features(s, d).withColumns({"label": F.expr("cast(sen < 0 as int)"), "row": F.expr("cast(pixel_id div 10 as int)"), "col": F.expr("cast(pixel_id % 10 as int)")})
    return spatial.block_folds(placed, 2, 10, 3)


def _small_forest():
    from ..config import Config

    return Config().override("forest.n_trees", 40).forest


add("sensitivity_sweep", None)(lambda s, d: experiment.sensitivity(S.supplier_months(s, d), S.MONTHS))
add("permutation_importance", None)(lambda s, d: experiment.importance_summary(experiment.permutation_importance(_samples(s, d), ["mk_z", "rain_sen", "cyc_score"], "label", 3, _small_forest(), 2)))
add("random_split_baseline", None)(lambda s, d: experiment.random_baseline(_samples(s, d), feature_names(["rainfall", "restrend", "cyclicity"]), "label", _small_forest()))
