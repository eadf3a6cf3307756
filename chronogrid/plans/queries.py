"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import series as S
from ..config import Config
from ..operators import breaks, evaluation, ingest, joins, models, quality, rules, spatial, spectral, trend, windows
from . import demo
from . import oracle_parts as O
from .features import GROUPS, feature_dictionary, feature_names, feature_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None):
    """Register a query; its double columns are rounded to 6 places."""

    def wrap(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: S.rounded(f(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def cols(**named: str) -> str:
    """Rounded columns of an oracle: name=expression."""
    return ", ".join(f"{O.r6(e)} AS {n}" for n, e in named.items())


SUP, USR = O.SUPPLIERS, O.USERS
HR83, HR30 = O.HR.replace("{last}", "41"), O.HR.replace("{last}", "15")
MK_COLS = "pixel_id, n::INTEGER AS n, s, " + cols(var="var", z="z", p=O.normal_p("z"), tau="tau", sen="sen")

# ---------------------------------------------------------------- trend


def _mk(df: DataFrame) -> DataFrame:
    return trend.sens_slope(trend.mann_kendall(df)).select("pixel_id", "mk.*", "sen")


add("mk_test", f"WITH {SUP}, {O.MK} SELECT {MK_COLS} FROM mk")(lambda s, d: _mk(S.supplier_months(s, d)))
add("mk_test_gappy", f"WITH {USR}, {O.MK} SELECT {MK_COLS} FROM mk")(lambda s, d: _mk(S.user_days(s, d)))
add("sens_slope", f"WITH {SUP}, {O.MK} SELECT pixel_id, {cols(sen='sen')} FROM mk")(lambda s, d: trend.sens_slope(S.supplier_months(s, d)).select("pixel_id", "sen"))
for _name, _src, _n, _base, _hr in (("mk_hamed_rao", S.supplier_months, 83, SUP, HR83), ("mk_hamed_rao_gappy", S.user_days, 30, USR, HR30)):
    add(_name, f"WITH {_base}, {O.MK}, {_hr} SELECT pixel_id, {cols(z='hz', p=O.normal_p('hz'), ratio='ratio')} FROM hrz")(
        lambda s, d, f=_src, n=_n: trend.hamed_rao(S.sealed(trend.mann_kendall(f(s, d))), n).select("pixel_id", "hr.*")
    )
add("significant_declines", f"WITH {SUP}, {O.MK}, {HR83} SELECT pixel_id, {cols(sen='sen', p=O.normal_p('hz'))} FROM hrz WHERE {O.normal_p('hz')} < 0.3 AND sen < 0 ORDER BY sen, pixel_id LIMIT 20")(
    lambda s, d: S.sealed(trend.sens_slope(S.sealed(trend.hamed_rao(S.sealed(trend.mann_kendall(S.supplier_months(s, d))), 83)))).select("pixel_id", "sen", F.col("hr.p").alias("p")).where("p < 0.3 and sen < 0").orderBy("sen", "pixel_id").limit(20)
)
add("ols_slope", f"WITH {USR} SELECT pixel_id, {cols(ols_slope='regr_slope(x, t)')} FROM s GROUP BY 1")(lambda s, d: trend.ols_slope(S.user_days(s, d)).select("pixel_id", "ols_slope"))
add("pearson", f"WITH {USR} SELECT pixel_id, {cols(correlation='CASE WHEN count(x) >= 3 THEN corr(x, r) END')} FROM s WHERE x IS NOT NULL GROUP BY 1")(lambda s, d: trend.pearson(S.user_days(s, d)).select("pixel_id", "correlation"))
add("descriptive", f"WITH {USR} SELECT pixel_id, count(x)::INTEGER AS n, {cols(mean='avg(x)', std='stddev_pop(x)', cv='stddev_pop(x) / avg(x)', amp='quantile_cont(x, 0.95) - quantile_cont(x, 0.05)', median='median(x)', min='min(x)', max='max(x)')} FROM s GROUP BY 1")(
    lambda s, d: quality.describe(S.user_days(s, d)).select("pixel_id", "ndvi_stats.*")
)
JOINT = "pixel_id, n, valid, " + cols(slope="slope", p="p", r2="r2", beta="beta", beta_p="beta_p")
add("restrend_joint", f"WITH {SUP}, {O.RESTREND} SELECT {JOINT} FROM joint")(lambda s, d: trend.restrend(S.supplier_months(s, d)).select("pixel_id", "restrend.*"))
add("restrend_joint_gappy", f"WITH {USR}, {O.RESTREND} SELECT {JOINT} FROM joint")(lambda s, d: trend.restrend(S.user_days(s, d)).select("pixel_id", "restrend.*"))
add("restrend_two_stage", f"""WITH {USR}, c AS (
  SELECT pixel_id, count(*)::DOUBLE AS n, regr_slope(x, r) AS beta, regr_intercept(x, r) AS b0, regr_r2(x, r) AS r2, var_pop(r) * count(*) AS yy, var_pop(t) * count(*) AS tt,
    (var_pop(x) - regr_slope(x, r) * covar_pop(x, r)) * count(*) AS sse1 FROM s WHERE x IS NOT NULL AND r IS NOT NULL GROUP BY 1
), e AS (SELECT pixel_id, t, x - b0 - beta * r AS e FROM s JOIN c USING (pixel_id) WHERE x IS NOT NULL AND r IS NOT NULL
), f AS (SELECT pixel_id, regr_slope(e, t) AS slope, (var_pop(e) - regr_slope(e, t) * covar_pop(e, t)) * count(*) AS sse FROM e GROUP BY 1
), g AS (SELECT c.*, slope, greatest(n - 2, 1) AS df, beta / sqrt(sse1 / (n - 2) / yy) AS tb, slope / sqrt(sse / (n - 2) / tt) AS ts FROM c JOIN f USING (pixel_id)
), h AS (SELECT *, {O.student_p('tb', 'df')} AS beta_p, {O.student_p('ts', 'df')} AS p FROM g)
SELECT pixel_id, n::INTEGER AS n, coalesce(n >= 10 AND r2 >= 0.1 AND beta_p < 0.05 AND beta > 0, false) AS valid, {cols(**{k: f'CASE WHEN n >= 10 THEN {k} END' for k in ('slope', 'p', 'r2', 'beta', 'beta_p')})} FROM h""")(
    lambda s, d: trend.restrend(S.user_days(s, d), cfg=Config().override("restrend.method", "two_stage").restrend).select("pixel_id", "restrend.*")
)

# ---------------------------------------------------------------- spectral, breaks

add("dft_power", f"WITH {SUP}, {O.spectrum(83)} SELECT pixel_id, k::INTEGER AS k, {cols(power='p')} FROM pw")(
    lambda s, d: S.sealed(spectral.dft_power(S.supplier_months(s, d), 83).select("pixel_id", "power")).select("pixel_id", F.posexplode("power").alias("i", "power")).select("pixel_id", (F.col("i") + 1).alias("k"), "power")
)
CYC = "pixel_id, coalesce(enrichment >= 2.0, false) AS periodic, " + cols(**{k: k for k in ("score", "enrichment", "period", "band_power", "total_power")})
for _name, _src, _n, _base in (("cyclicity", S.supplier_months, 83, SUP), ("cyclicity_gappy", S.user_days, 30, USR)):
    add(_name, f"WITH {_base}, {O.spectrum(_n)} SELECT {CYC} FROM cyc")(lambda s, d, f=_src, n=_n: spectral.cyclicity(f(s, d), n).select("pixel_id", "cyc.*"))
add("dominant_period", f"WITH {SUP}, {O.spectrum(83)} SELECT {cols(period='period')}, count(*) AS n_pixels FROM cyc GROUP BY period")(
    lambda s, d: S.sealed(spectral.cyclicity(S.supplier_months(s, d), 83).select("cyc")).groupBy(F.col("cyc.period").alias("period")).agg(F.count(F.lit(1)).alias("n_pixels"))
)
BRK = "pixel_id, k AS index, significant, " + cols(delta_slope="d", gain="gain", f_stat="f", p="p", p_adjusted="padj")
REC = "pixel_id, tt::INTEGER AS trough_index, status::INTEGER AS status, " + cols(pre_level="pre", trough_value="tx", disturbance_magnitude="mag", recovery_magnitude="back", recovery_fraction="frac", recovery_duration="dur", recovery_slope="slope")
for _tag, _src, _n, _base in (("", S.supplier_months, 83, SUP), ("_gappy", S.user_days, 30, USR)):
    add(f"breakpoint{_tag}", f"WITH {_base}, {O.breaks(_n)} SELECT {BRK} FROM brk")(lambda s, d, f=_src, n=_n: breaks.breakpoint(f(s, d), n).select("pixel_id", "brk.*"))
    add(f"recovery{_tag}", f"WITH {_base}, {O.breaks(_n)}, {O.RECOVERY} SELECT {REC} FROM rec")(lambda s, d, f=_src, n=_n: breaks.recovery(S.sealed(breaks.breakpoint(f(s, d), n)), n).select("pixel_id", "rec.*"))
add("recovery_summary", f"WITH {USR}, {O.breaks(30)}, {O.RECOVERY} SELECT status::INTEGER AS status, count(*) AS n_pixels, {cols(median_duration='median(dur)', median_fraction='median(frac)')} FROM rec GROUP BY 1")(
    lambda s, d: S.sealed(breaks.recovery(S.sealed(breaks.breakpoint(S.user_days(s, d), 30)), 30).select("rec")).groupBy(F.col("rec.status").alias("status")).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.percentile("rec.recovery_duration", F.lit(0.5)).alias("median_duration"), F.percentile("rec.recovery_fraction", F.lit(0.5)).alias("median_fraction"))
)
add("break_histogram", f"WITH {SUP}, {O.breaks(83)} SELECT (1995 + k // 12)::INTEGER AS year, count(*) AS n_pixels, count(*) FILTER (significant) AS n_significant FROM brk WHERE k >= 0 GROUP BY 1")(
    lambda s, d: S.sealed(breaks.breakpoint(S.supplier_months(s, d), 83).select("pixel_id", "brk")).where("brk.index >= 0").groupBy(F.expr("cast(1995 + brk.index div 12 as int)").alias("year")).agg(F.count(F.lit(1)).alias("n_pixels"), F.sum(F.col("brk.significant").cast("long")).alias("n_significant"))
)

# ---------------------------------------------------------------- quality

QUAL = """q AS (SELECT pixel_id, count(y) AS n, 1 - count(y) / 30.0 AS miss, coalesce(var_pop(y), 0) AS v FROM (SELECT pixel_id, CASE WHEN x BETWEEN -1 AND 1 THEN x END AS y FROM s) GROUP BY 1
), qf AS (SELECT *, CASE WHEN n = 0 THEN 4 WHEN n < 10 THEN 1 WHEN miss > 0.4 THEN 2 WHEN v < 1e-8 THEN 3 ELSE 0 END AS flag FROM q)"""
add("quality_flags", f"WITH {USR}, {QUAL} SELECT pixel_id, n::INTEGER AS valid_count, flag::INTEGER AS flag, {cols(missing_fraction='miss', variance='v')} FROM qf")(lambda s, d: quality.assess(S.user_days(s, d), 30).select("pixel_id", "quality.*"))
add("quality_summary", f"WITH {USR}, {QUAL}, names(flag, name) AS (VALUES (0, 'OK'), (1, 'INSUFFICIENT_OBS'), (2, 'TOO_MANY_MISSING'), (3, 'CONSTANT'), (4, 'OUT_OF_RANGE')) SELECT names.flag, name, count(qf.flag) AS n_pixels FROM names LEFT JOIN qf ON qf.flag = names.flag GROUP BY 1, 2")(
    lambda s, d: quality.summary(quality.assess(S.user_days(s, d), 30))
)
add("usable_pixels", f"WITH {USR}, {QUAL} SELECT pixel_id FROM qf WHERE flag = 0")(lambda s, d: quality.usable(S.user_days(s, d), 30).select("pixel_id"))
add("sanitize", f"WITH {USR} SELECT pixel_id, t::INTEGER AS t, {cols(ndvi='CASE WHEN x BETWEEN 0.1 AND 0.5 THEN x END')} FROM s")(
    lambda s, d: S.to_long(quality.sanitize(S.user_days(s, d), cfg=Config().override("quality.ndvi_min", 0.1).override("quality.ndvi_max", 0.5).quality)).select("pixel_id", "t", "ndvi")
)
add("gap_islands", f"""WITH {USR}, ends AS (SELECT pixel_id, min(t) AS a, max(t) AS b FROM s WHERE x IS NOT NULL GROUP BY 1),
g AS (SELECT pixel_id, t, t - row_number() OVER (PARTITION BY pixel_id ORDER BY t) AS i FROM s WHERE x IS NULL)
SELECT g.pixel_id, min(t)::INTEGER AS start, max(t)::INTEGER AS "end", count(*) AS length, coalesce(min(t) > any_value(a) AND max(t) < any_value(b), false) AS interior FROM g LEFT JOIN ends USING (pixel_id) GROUP BY g.pixel_id, i""")(
    lambda s, d: quality.gap_runs(S.to_long(S.user_days(s, d)))
)
add("gap_fill", f"""WITH {USR}, near AS (
  SELECT s.pixel_id, s.t, s.x, max(b.t) FILTER (b.t < s.t) AS ta, min(b.t) FILTER (b.t > s.t) AS tb FROM s LEFT JOIN (SELECT * FROM s WHERE x IS NOT NULL) b USING (pixel_id) GROUP BY 1, 2, 3
) SELECT near.pixel_id, near.t::INTEGER AS t, {cols(ndvi='CASE WHEN near.x IS NULL AND tb - ta - 1 <= 2 THEN a.x + (b.x - a.x) * (near.t - ta) / (tb - ta) ELSE near.x END')}
FROM near LEFT JOIN s a ON a.pixel_id = near.pixel_id AND a.t = ta LEFT JOIN s b ON b.pixel_id = near.pixel_id AND b.t = tb""")(
    lambda s, d: S.to_long(quality.fill_gaps(S.user_days(s, d), 30)).select("pixel_id", "t", "ndvi")
)
add("describe_signal", f"WITH {USR}, v AS (SELECT 'ndvi' AS variable, x AS v FROM s UNION ALL SELECT 'rain', r FROM s) SELECT variable, count(*) AS n_cells, count(*) - count(v) AS n_missing, {cols(missing_fraction='1 - count(v) / count(*)', min='min(v)', max='max(v)', mean='avg(v)', median='median(v)', std='stddev_pop(v)', p05='quantile_cont(v, 0.05)', p95='quantile_cont(v, 0.95)')} FROM v GROUP BY 1")(
    lambda s, d: quality.describe_all(S.to_long(S.user_days(s, d)), "ndvi", "rain")
)
add("step_stats", f"WITH {USR} SELECT t::INTEGER AS t, {cols(mean='avg(x)', p10='quantile_cont(x, 0.1)', p90='quantile_cont(x, 0.9)', valid_fraction='count(x) / count(*)', rain_mean='avg(r)')} FROM s GROUP BY t")(lambda s, d: quality.step_stats(S.to_long(S.user_days(s, d))))
add("availability_trend", f"WITH {USR}, a AS (SELECT t, count(x) / count(*) AS a FROM s GROUP BY 1) SELECT {cols(slope_per_step='regr_slope(a, t)', intercept='regr_intercept(a, t)', correlation_with_time='corr(a, t)')} FROM a")(lambda s, d: quality.availability_trend(S.to_long(S.user_days(s, d))))
add("dataset_validation", f"WITH {USR} SELECT count(*) AS n_cells, count(DISTINCT pixel_id) AS n_pixels, count(DISTINCT t) AS n_time, count(*) - count(x) AS n_missing, {cols(ndvi_min='min(x)', ndvi_max='max(x)')}, count(*) FILTER (NOT x BETWEEN -1 AND 1) AS n_out_of_range, count(*) FILTER (r < 0) AS n_negative_rain FROM s")(lambda s, d: quality.validate(S.to_long(S.user_days(s, d))))

# ---------------------------------------------------------------- ingest

REFL = demo.SCENES_SQL


def _reflectance(s: SparkSession, d: str) -> DataFrame:
    joined = demo.scenes(s, d).join(F.broadcast(ingest.sensor_table(s)), "sensor")
    return joined.withColumns({b: ingest.scale_factors(F.col(b), F.col("scale"), F.col("offset")) for b in ("red", "nir", "blue", "swir1", "swir2")})



def _height(cells: DataFrame, least: int) -> int:
    """Rows of the grid: down to the last cell of the table, ``least`` at least."""
    last = cells.agg(F.max("row")).collect()[0][0]
    return max(least, -1 if last is None else last + 1)


def _aggregated(s: SparkSession, d: str) -> DataFrame:
    cells = demo.grid_cells(s, d)
    return ingest.block_aggregate(cells, 3, _height(cells, 50), 40)


# The factor keeps results off the middle between two roundings.
add("scale_factors", f"WITH {REFL} SELECT scene_id, {cols(red='red * 1.0317', nir='nir * 1.0317')} FROM refl")(lambda s, d: _reflectance(s, d).select("scene_id", (F.col("red") * 1.0317).alias("red"), (F.col("nir") * 1.0317).alias("nir")))
add("qa_mask", f"WITH {REFL} SELECT scene_id, (qa & 63) = 0 AND radsat = 0 AS usable, (qa & 63) = 0 AND ((qa >> 8) & 3) <= 2 AS strict FROM sc")(
    lambda s, d: demo.scenes(s, d).select("scene_id", ingest.qa_usable(F.col("qa"), F.col("radsat")).alias("usable"), ingest.qa_usable(F.col("qa"), most_confidence=2).alias("strict"))
)
add("scl_mask", f"WITH {REFL} SELECT scene_id, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS usable FROM sc")(lambda s, d: demo.scenes(s, d).select("scene_id", ingest.scl_usable(F.col("scl")).alias("usable")))
for _i, (_num, _den) in {"ndvi": ("nir - red", "nir + red"), "evi": ("2.5 * (nir - red)", "nir + 6 * red - 7.5 * blue + 1"), "nbr": ("nir - swir2", "nir + swir2"), "ndmi": ("nir - swir1", "nir + swir1")}.items():
    _v = f"CASE WHEN abs({_den}) >= 1e-10 AND ({_num}) / ({_den}) BETWEEN -1 AND 1 THEN ({_num}) / ({_den}) END"
    add(f"index_{_i}", f"WITH {REFL} SELECT scene_id, {cols(value=_v)} FROM refl")(lambda s, d, i=_i: _reflectance(s, d).select("scene_id", ingest.spectral_index(i).alias("value")))
add("harmonise", f"WITH {demo.OBSERVATIONS_SQL} SELECT scene_id, sensor, {cols(value='value')} FROM ob")(lambda s, d: demo.observations(s, d).select("scene_id", "sensor", "value"))
add("cloud_prefilter", f"WITH {REFL} SELECT scene_id, coalesce(cloud_cover > 80, false) AS skipped FROM sc")(lambda s, d: ingest.cloud_prefilter(demo.scenes(s, d)).select("scene_id", "skipped"))
add("sensor_table", f"WITH {REFL} SELECT sensor, scale, off AS \"offset\", gain, bias FROM sensors")(lambda s, d: ingest.sensor_table(s))
QUERIES["sensor_table"] = lambda s, d: ingest.sensor_table(s)
add("block_aggregate", f"WITH {demo.CELLS_SQL} SELECT (row // 3)::INTEGER AS block_row, (col // 3)::INTEGER AS block_col, {cols(mean='avg(value)', median='median(value)', std='stddev_pop(value)')}, count(value) AS n_valid FROM ce WHERE row < (SELECT greatest(50, max(row) + 1) // 3 * 3 FROM ce) AND col < 39 GROUP BY 1, 2")(
    _aggregated
)

# ---------------------------------------------------------------- windows

ANNUAL = "w AS (SELECT (y - 1995)::INTEGER AS t, y::VARCHAR AS label, make_date(y, 10, 15) AS \"start\", make_date(y, 12, 31) AS \"end\", y::INTEGER AS year FROM (SELECT unnest(range(1995, 2002)) AS y))"
add("annual_windows", f"WITH {ANNUAL} SELECT * FROM w")(lambda s, d: windows.build_windows(s, "annual", 1995, 2001))
add("crossing_windows", "SELECT (y - 1995)::INTEGER AS t, y::VARCHAR AS label, make_date(y, 11, 15) AS \"start\", make_date(y + 1, 2, 15) AS \"end\", y::INTEGER AS year FROM (SELECT unnest(range(1995, 2002)) AS y)")(lambda s, d: windows.annual_windows(s, 1995, 2001, "11-15", "02-15"))
add("seasonal_windows", "SELECT ((y - 1995) * 4 + i)::INTEGER AS t, y || '-' || n AS label, (y || '-' || a)::DATE AS \"start\", (y || '-' || b)::DATE AS \"end\", y::INTEGER AS year FROM (SELECT unnest(range(1995, 2002)) AS y) CROSS JOIN (VALUES (0, 'DJF', '01-01', '02-28'), (1, 'MAM', '03-01', '05-31'), (2, 'JJA', '06-01', '08-31'), (3, 'SON', '09-01', '11-30')) v(i, n, a, b)")(
    lambda s, d: windows.build_windows(s, "seasonal", 1995, 2001)
)
add("monthly_windows", "SELECT ((y - 1995) * 12 + m - 1)::INTEGER AS t, strftime(make_date(y, m, 1), '%Y-%m') AS label, make_date(y, m, 1) AS \"start\", last_day(make_date(y, m, 1)) AS \"end\", y::INTEGER AS year FROM (SELECT unnest(range(1995, 2002)) AS y) CROSS JOIN (SELECT unnest(range(1, 13)) AS m)")(
    lambda s, d: windows.build_windows(s, "monthly", 1995, 2001)
)
COMP = """{ob}, {annual}, ns AS (SELECT w.t, count(ob.scene_id) AS n FROM w LEFT JOIN ob ON obs_date BETWEEN w."start" AND w."end" GROUP BY 1
), cp AS (SELECT p.pixel_id, ns.t, {stat} AS v, count(value) AS n_valid, any_value(ns.n) - count(value) AS n_masked
  FROM (SELECT DISTINCT pixel_id FROM ob) p CROSS JOIN w JOIN ns USING (t) LEFT JOIN ob ON ob.pixel_id = p.pixel_id AND obs_date BETWEEN w."start" AND w."end" GROUP BY 1, 2)"""
STATS = {"median": "median(value)", "mean": "avg(value)", "max": "max(value)", "min": "min(value)", "percentile": "quantile_cont(value, 0.9)"}


def _comp(stat: str) -> str:
    return COMP.format(ob=demo.OBSERVATIONS_SQL, annual=ANNUAL, stat=STATS[stat])


for _s in STATS:
    add(f"composite_{_s}", f"WITH {_comp(_s)} SELECT pixel_id, t, {cols(value='v')}, n_valid, n_masked FROM cp")(lambda s, d, k=_s: windows.composite(demo.observations(s, d), windows.annual_windows(s, 1995, 2001), k))
add("composite_summary", f"WITH {_comp('median')} SELECT t, {cols(missing_fraction='1 - count(v) / count(*)', mean_valid='avg(n_valid)', mean_masked='avg(n_masked)')}, count(v) = 0 AS empty FROM cp GROUP BY t")(
    lambda s, d: windows.composite_summary(windows.composite(demo.observations(s, d), windows.annual_windows(s, 1995, 2001)))
)
add("window_scenes", f"WITH {_comp('median')} SELECT t, n AS n_scenes FROM ns")(lambda s, d: windows.window_scenes(demo.observations(s, d), windows.annual_windows(s, 1995, 2001)))


def _rain(s: SparkSession, d: str) -> DataFrame:
    """Monthly order totals of 5 regions of customers as rain."""
    return S.table(s, d, "orders").groupBy(F.expr("o_custkey % 5").alias("pixel_id"), F.expr("date_add(trunc(o_orderdate, 'month'), 14)").alias("obs_date")).agg(F.round(F.sum("o_totalprice"), 2).alias("rain"))


add("rain_accumulate", f"""WITH {ANNUAL}, rn AS (SELECT o_custkey % 5 AS pixel_id, date_trunc('month', o_orderdate)::DATE + 14 AS obs_date, round(sum(o_totalprice), 2) AS rain FROM orders GROUP BY 1, 2
), ds AS (SELECT DISTINCT obs_date FROM rn), sp AS (SELECT greatest(floor(median(g)), 1) AS spacing FROM (SELECT obs_date - lag(obs_date) OVER (ORDER BY obs_date) AS g FROM ds) WHERE g > 0
), mem AS (SELECT t, "end" - 364 AS lo, "end" AS hi, (SELECT count(*) FROM ds WHERE obs_date BETWEEN "end" - 364 AND "end") AS m FROM w
) SELECT p.pixel_id, mem.t, {cols(total='CASE WHEN any_value(m) / greatest(365 / any_value(spacing), 1) >= 0.9 AND count(rain) = any_value(m) THEN sum(rain) END')}
FROM (SELECT DISTINCT pixel_id FROM rn) p CROSS JOIN mem CROSS JOIN sp LEFT JOIN rn ON rn.pixel_id = p.pixel_id AND obs_date BETWEEN lo AND hi GROUP BY 1, 2""")(
    lambda s, d: windows.accumulate_rain(_rain(s, d), windows.annual_windows(s, 1995, 2001))
)
add("holdout_split", f"WITH {SUP} SELECT pixel_id, CASE WHEN t < 54 THEN 'history' ELSE 'future' END AS part, count(*)::INTEGER AS steps, {cols(mean='avg(x)')} FROM s GROUP BY 1, 2")(
    lambda s, d: quality.describe(windows.holdout_split(S.supplier_months(s, d), 83)).select("pixel_id", "part", F.size("ndvi").alias("steps"), F.col("ndvi_stats.mean").alias("mean"))
)

# ---------------------------------------------------------------- features and rules


def feature_sql(base: str, n: int, last: int) -> str:
    """CTEs that end in ``ft``, the feature table, put together from the parts."""
    yes = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
    dist = "rec.status <> 0"
    columns = {
        "mean": "ds.mean", "median_ndvi": "ds.med", "minimum_ndvi": "ds.mn", "maximum_ndvi": "ds.mx", "std": "ds.sd", "cv": "ds.sd / ds.mean", "amp": "ds.amp", "sen": "hp.sen", "ols_slope": "ds.ols",
        "mk_z": "hp.hz", "mk_p_value": "hp.p", "mk_tau": "hp.tau", "mk_significant": yes("hp.p < 0.05"), "trend_direction": "sign(hp.sen)",
        "rain_mean": "ds.rm", "rain_std": "ds.rs", "rain_cv": "ds.rs / ds.rm", "rain_sen": "CASE WHEN ds.nr >= 10 THEN rsen.med END", "rain_ndvi_correlation": "CASE WHEN joint.n >= 3 THEN ds.co END",
        "restrend": "joint.slope", "restrend_p_value": "joint.p", "restrend_r2": "joint.r2", "restrend_beta": "joint.beta", "restrend_valid": yes("joint.valid"), "restrend_significant": yes("joint.p < 0.05 AND joint.valid"),
        "cyc_score": "cyc.score", "cyc_enrichment": "cyc.enrichment", "cyc_period": "coalesce(cyc.period, 0)", "cyc_band_power": "cyc.band_power", "cyc_total_power": "cyc.total_power", "cyclicity_periodic": yes("cyc.enrichment >= 2"),
        "has_break": yes("brk.k >= 0"), "break_t": f"CASE WHEN brk.k >= 0 THEN brk.k / {n}.0 ELSE 0.0 END", "break_dslope": "CASE WHEN brk.k >= 0 THEN coalesce(brk.d, 0) ELSE 0.0 END", "break_gain": "CASE WHEN brk.k >= 0 THEN coalesce(brk.gain, 0) ELSE 0.0 END",
        "breakpoint_index": "brk.k::DOUBLE", "breakpoint_significant": yes("brk.significant"), "pre_breakpoint_level": "CASE WHEN brk.k >= 0 THEN coalesce(rec.pre, 0) ELSE 0.0 END", "post_breakpoint_minimum": "CASE WHEN brk.k >= 0 THEN coalesce(rec.tx, 0) ELSE 0.0 END",
        "disturbance_magnitude": f"CASE WHEN {dist} THEN coalesce(rec.mag, 0) ELSE 0.0 END", "has_disturbance": yes(dist), "recovery_magnitude": f"CASE WHEN {dist} THEN coalesce(rec.back, 0) ELSE 0.0 END", "recovery_fraction": f"CASE WHEN {dist} THEN coalesce(rec.frac, 0) ELSE 0.0 END",
        "recovery_duration": f"CASE WHEN {dist} THEN coalesce(rec.dur, 0) ELSE 0.0 END", "recovery_slope": f"CASE WHEN {dist} THEN coalesce(rec.slope, 0) ELSE 0.0 END", "recovery_status": "rec.status::DOUBLE", "n_valid_ndvi": "ds.nx::DOUBLE", "n_valid_pairs": "joint.n::DOUBLE",
    }
    spectrum = O.spectrum(n).replace("m AS (SELECT", "mm AS (SELECT", 1).replace("JOIN m USING", "JOIN mm USING")
    return f"""{base}, {O.MK}, {O.HR.replace('{last}', str(last))}, {O.RESTREND}, {spectrum}, {O.breaks(n)}, {O.RECOVERY}, hp AS (SELECT *, {O.normal_p('hz')} AS p FROM hrz
), ds AS (SELECT pixel_id, avg(x) AS mean, median(x) AS med, min(x) AS mn, max(x) AS mx, stddev_pop(x) AS sd, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS amp, regr_slope(x, t) AS ols,
  avg(r) AS rm, stddev_pop(r) AS rs, count(r) AS nr, count(x) AS nx, corr(x, r) AS co FROM s GROUP BY 1
), rsen AS (SELECT a.pixel_id, median((b.r - a.r) / (b.t - a.t)) AS med FROM s a JOIN s b ON a.pixel_id = b.pixel_id AND a.t < b.t WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1
), ft AS (SELECT ds.pixel_id, {', '.join(f'{columns[c]} AS {c}' for c in feature_names())}
  FROM ds JOIN hp USING (pixel_id) LEFT JOIN joint USING (pixel_id) LEFT JOIN cyc USING (pixel_id) LEFT JOIN brk USING (pixel_id) LEFT JOIN rec USING (pixel_id) LEFT JOIN rsen USING (pixel_id))"""


FT83, FT30 = feature_sql(SUP, 83, 41), feature_sql(USR, 30, 15)
ALL = cols(**{c: c for c in feature_names()})
add("feature_table", f"WITH {FT83} SELECT pixel_id, {ALL} FROM ft")(demo.supplier_features)
add("feature_table_gappy", f"WITH {FT30} SELECT pixel_id, {ALL} FROM ft")(demo.user_features)
add("feature_groups", f"WITH {FT30} SELECT pixel_id, {cols(**{c: c for c in feature_names(['trend', 'rainfall'])})} FROM ft")(lambda s, d: demo.user_features(s, d).select("pixel_id", *feature_names(["trend", "rainfall"])))
add("feature_dictionary", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{g}', {i})" for i, (c, g) in enumerate((c, g) for g, cs in GROUPS.items() for c in cs)) + ") v(feature, grp, position)")(lambda s, d: feature_dictionary(s))

LOOSE = Config().override("trend.alpha", 0.3).override("cyclicity.periodicity_threshold", 1.3).override("trajectory.require_significant_breakpoint", False)
DOWN, UP, ADJ = "coalesce(mk_p_value < 0.3 AND sen < 0, false)", "coalesce(mk_p_value < 0.3 AND sen > 0, false)", "coalesce(restrend_p_value < 0.3 AND restrend < 0, false)"
CLASS = f"""fx AS (SELECT *, {DOWN} AS down, {UP} AS up, {ADJ} AS adj, {DOWN} AND restrend_valid > 0 AND NOT {ADJ} AS expl, coalesce(cyc_enrichment >= 1.3, false) AND cyclicity_periodic > 0 AS cycl,
  has_disturbance > 0 AND disturbance_magnitude >= 0.05 AS drp FROM (SELECT * REPLACE (CASE WHEN cyc_enrichment >= 1.3 THEN 1.0 ELSE 0.0 END AS cyclicity_periodic) FROM ft)
), tj AS (SELECT *, CASE WHEN mean IS NULL OR sen IS NULL OR mk_z IS NULL THEN 'Uncertain / Other' WHEN drp AND recovery_fraction >= 0.8 THEN 'Recovering' WHEN down AND NOT expl THEN 'Degrading'
  WHEN expl THEN 'Rainfall-associated decline' WHEN drp THEN 'Disturbed' WHEN cycl THEN 'Cyclic' WHEN NOT up THEN 'Stable' ELSE 'Uncertain / Other' END AS trajectory FROM fx)"""


def _loose(s: SparkSession, d: str) -> DataFrame:
    return feature_table(S.user_days(s, d), 30, LOOSE)


CODES = ", ".join(f"('{k}', {v})" for k, v in rules.CODES.items())
add("trajectory_classes", f"WITH {FT30}, {CLASS}, cd(trajectory, code) AS (VALUES {CODES}) SELECT pixel_id, tj.trajectory, code AS trajectory_code FROM tj JOIN cd USING (trajectory)")(lambda s, d: rules.classify(_loose(s, d), LOOSE).select("pixel_id", "trajectory", "trajectory_code"))
add("trajectory_summary", f"WITH {FT30}, {CLASS}, cd(trajectory, code) AS (VALUES {CODES}) SELECT cd.trajectory, code, count(pixel_id) AS n_pixels, {cols(fraction='count(pixel_id) / (SELECT count(*) FROM tj)')} FROM cd LEFT JOIN tj USING (trajectory) GROUP BY 1, 2")(lambda s, d: rules.summary(rules.classify(_loose(s, d), LOOSE)))
KEPT = "(down AND (adj OR NOT restrend_valid > 0))"
FINAL = f"({KEPT} AND NOT cycl AND NOT (has_disturbance > 0 AND recovery_fraction >= 0.8))"
HALF = "least(greatest(coalesce(mk_p_value, 1) / 2, 0), 0.5)"
ADJUSTED = f"CASE WHEN {KEPT} THEN 1 - coalesce(restrend_p_value, 0.5) ELSE {HALF} END"
add("baseline_rules", f"WITH {FT30}, {CLASS} SELECT pixel_id, down::INTEGER AS trend_flag, {KEPT}::INTEGER AS restrend_flag, {FINAL}::INTEGER AS integrated_flag, {cols(trend_score=f'CASE WHEN mk_p_value IS NULL THEN 0.5 WHEN down THEN 1 - mk_p_value ELSE {HALF} END', restrend_score=ADJUSTED, integrated_score=f'CASE WHEN {FINAL} THEN {ADJUSTED} ELSE least({ADJUSTED}, 0.5) END')} FROM tj")(
    lambda s, d: rules.baselines(_loose(s, d), LOOSE)
)
add("productivity_3class", f"WITH {FT30}, {CLASS} SELECT {cols(pct_declining='100.0 * count(*) FILTER (down) / count(*)', pct_stable='100.0 * count(*) FILTER (NOT down AND NOT up) / count(*)', pct_increasing='100.0 * count(*) FILTER (up) / count(*)')}, count(*) AS n_assessed FROM tj WHERE mk_p_value IS NOT NULL AND sen IS NOT NULL")(lambda s, d: rules.productivity(_loose(s, d), LOOSE))
add("restrend_categories", f"WITH {FT30}, {CLASS} SELECT CASE WHEN down AND NOT restrend_valid > 0 THEN 'decline_not_adjustable_weak_rainfall_relation' WHEN down AND adj THEN 'decline_persists_after_climate_adjustment' WHEN down THEN 'decline_largely_explained_by_rainfall' WHEN up THEN 'significant_increase' ELSE 'stable_or_no_significant_trend' END AS category, count(*) AS n_pixels, {cols(fraction='count(*) / (SELECT count(*) FROM tj)')} FROM tj GROUP BY 1")(lambda s, d: rules.restrend_categories(_loose(s, d), LOOSE))
add("exclusion_reasons", f"WITH {FT30}, iv AS (SELECT * FROM ft WHERE NOT restrend_valid > 0) SELECT 'insufficient_valid_observations' AS reason, count(*) FILTER (n_valid_ndvi < 10) AS n_pixels FROM iv UNION ALL SELECT 'rainfall_relation_too_weak', count(*) FILTER (restrend_r2 < 0.1 AND n_valid_ndvi >= 10) FROM iv UNION ALL SELECT 'rainfall_sensitivity_not_positive', count(*) FILTER (restrend_beta <= 0 AND NOT coalesce(restrend_r2 < 0.1, false) AND n_valid_ndvi >= 10) FROM iv UNION ALL SELECT 'regression_not_estimable', count(*) FILTER (restrend_r2 IS NULL) FROM iv")(lambda s, d: rules.exclusion_reasons(demo.user_features(s, d)))
AGREE = "(down::INTEGER + (restrend_valid > 0 AND adj)::INTEGER + (breakpoint_significant > 0)::INTEGER)"
add("indicator_agreement", f"WITH {FT30}, {CLASS} SELECT pixel_id, {AGREE} AS agreeing, {AGREE} = 1 OR (cyclicity_periodic > 0 AND {AGREE} >= 1) AS ambiguous, n_valid_ndvi < 13 AS thin FROM tj")(lambda s, d: rules.agreement(_loose(s, d), LOOSE))
add("reassignment", f"WITH {FT30}, {CLASS} SELECT down::INTEGER AS trend_flag, trajectory, count(*) AS n_pixels FROM tj GROUP BY 1, 2")(lambda s, d: rules.reassignment(_loose(s, d), LOOSE))
add("uncertain_composition", f"WITH {FT30}, {CLASS} SELECT count(*) FILTER (trajectory LIKE 'Unc%') AS n_uncertain, count(*) FILTER (trajectory LIKE 'Unc%' AND up) AS n_greening, count(*) FILTER (trajectory LIKE 'Unc%' AND NOT up) AS n_unmatched, {cols(fraction='''count(*) FILTER (trajectory LIKE 'Unc%') / count(*)''')} FROM tj")(lambda s, d: rules.uncertain_composition(_loose(s, d), LOOSE))
CONDS = {"significant_decline": "down", "significant_increase": "up", "no_significant_trend": "NOT coalesce(mk_p_value < 0.3, false)", "climate_adjusted_decline": "restrend_valid > 0 AND adj", "cyclic_signal": "cyclicity_periodic > 0", "disturbance_detected": "has_disturbance > 0", "recovering_after_disturbance": "recovery_status = 2"}
add("condition_areas", f"WITH {FT30}, {CLASS} " + " UNION ALL ".join(f"SELECT '{k}' AS condition, count(*) FILTER ({c}) AS n_pixels, {O.r6(f'count(*) FILTER ({c}) * 0.09')} AS area_km2 FROM tj" for k, c in CONDS.items()))(lambda s, d: rules.condition_areas(_loose(s, d), 0.09, LOOSE))
SENS = " UNION ALL ".join(f"SELECT {a} AS alpha, count(*) FILTER (mk_p_value < {a} AND sen < 0) / count(*)::DOUBLE AS declining, count(*) FILTER (mk_p_value < {a} AND sen > 0) / count(*)::DOUBLE AS increasing FROM ft" for a in (0.01, 0.05, 0.1))
add("sensitivity_alpha", f"WITH {FT83}, v AS ({SENS}) SELECT alpha::DOUBLE AS alpha, {cols(declining='declining', increasing='increasing')} FROM v")(
    # the estimators do not depend on alpha: one table serves all scenarios
    lambda s, d: demo.supplier_features(s, d).select("mk_p_value", "sen", F.explode(F.array(F.lit(0.01), F.lit(0.05), F.lit(0.1))).alias("alpha")).groupBy("alpha").agg(
        F.avg(F.expr("if(coalesce(mk_p_value < alpha and sen < 0, false), 1D, 0D)")).alias("declining"), F.avg(F.expr("if(coalesce(mk_p_value < alpha and sen > 0, false), 1D, 0D)")).alias("increasing"))
)
add("sensitivity_spread", f"WITH {FT83}, v AS ({SENS}) SELECT {cols(low='min(declining)', high='max(declining)', spread='max(declining) - min(declining)')} FROM v")(
    lambda s, d: QUERIES_RAW["sensitivity_alpha"](s, d).agg(F.min("declining").alias("low"), F.max("declining").alias("high"), (F.max("declining") - F.min("declining")).alias("spread"))
)
QUERIES_RAW = {"sensitivity_alpha": QUERIES["sensitivity_alpha"]}
REPR = ("sen", "mk_p_value", "restrend", "cyc_enrichment", "disturbance_magnitude", "recovery_fraction")
add("representative_pixel", f"""WITH {FT30}, {CLASS}, pool AS (SELECT * FROM (SELECT *, max(n_valid_ndvi >= 25) OVER (PARTITION BY trajectory) AS anyv FROM tj) WHERE n_valid_ndvi >= 25 OR NOT anyv
), st AS (SELECT trajectory, count(*) AS n_candidates, {', '.join(f'median({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in REPR)} FROM pool GROUP BY 1
), sd AS (SELECT trajectory, pixel_id, n_candidates, round({' + '.join(f'coalesce(abs({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 0)' for c in REPR)}, 9) AS dd FROM pool JOIN st USING (trajectory))
SELECT trajectory, arg_min(pixel_id, (dd, pixel_id)) AS pixel_id, {cols(distance='min(dd)')}, any_value(n_candidates) AS n_candidates FROM sd GROUP BY 1""")(lambda s, d: joins.representative(rules.classify(_loose(s, d), LOOSE)))

# ---------------------------------------------------------------- spatial

GRID = f"""{demo.CELLS_SQL}, bl AS (SELECT *, (row // 8)::INTEGER AS block_row, (col // 8)::INTEGER AS block_col, ((row // 8) * 5 + col // 8)::INTEGER AS block_id FROM ce
), fo AS (SELECT block_id, ((row_number() OVER (ORDER BY md5('42:' || block_id)) - 1) % 5)::INTEGER AS fold FROM (SELECT DISTINCT block_id FROM bl)), bf AS (SELECT * FROM bl JOIN fo USING (block_id))"""


def _folds(s: SparkSession, d: str) -> DataFrame:
    return spatial.block_folds(demo.grid_cells(s, d), 8, 40, 5)


add("block_folds", f"WITH {GRID} SELECT pixel_id, block_id, fold FROM bf")(lambda s, d: _folds(s, d).select("pixel_id", "block_id", "fold"))
add("buffer_anti_join", f"WITH {GRID}, te AS (SELECT DISTINCT block_row, block_col FROM bf WHERE fold = 0) SELECT pixel_id FROM bf b WHERE fold <> 0 AND NOT EXISTS (SELECT 1 FROM te WHERE abs(te.block_row - b.block_row) <= 1 AND abs(te.block_col - b.block_col) <= 1)")(lambda s, d: spatial.buffered_training(_folds(s, d), 0, 1).select("pixel_id"))
add("buffer_separation", f"WITH {GRID} SELECT min(greatest(abs(a.block_row - b.block_row), abs(a.block_col - b.block_col))) AS minimum_block_distance FROM bl a JOIN fo x ON x.block_id = a.block_id AND x.fold <> 0 CROSS JOIN (SELECT DISTINCT block_row, block_col FROM bf WHERE fold = 0) b")(lambda s, d: spatial.buffer_separation(_folds(s, d), 0))
add("block_purity", f"WITH {GRID} SELECT count(*) AS n_blocks, count(*) FILTER (f > 1) AS n_split FROM (SELECT block_id, count(DISTINCT fold) AS f FROM bf GROUP BY 1)")(lambda s, d: evaluation.block_purity(_folds(s, d)))
add("sample_overlap", f"WITH {GRID} SELECT count(*) AS overlap FROM (SELECT pixel_id FROM bf WHERE fold IN (0, 1) INTERSECT SELECT pixel_id FROM bf WHERE fold IN (1, 2))")(lambda s, d: evaluation.sample_overlap(_folds(s, d).where("fold in (0, 1)"), _folds(s, d).where("fold in (1, 2)")))
AREA = "6371.0072 * 6371.0072 * radians(0.1) * abs(sin(radians(26.0 - 0.1 * row)) - sin(radians(26.0 - 0.1 * (row + 1))))"
add("pixel_area", f"WITH {demo.CELLS_SQL} SELECT pixel_id, {cols(area_km2=AREA)} FROM ce")(lambda s, d: spatial.pixel_area(demo.grid_cells(s, d), demo.TOP, demo.STEP).select("pixel_id", "area_km2"))
add("area_stats", f"WITH {demo.CELLS_SQL}, a AS (SELECT floor(value / 250)::INTEGER AS class, {AREA} AS k FROM ce WHERE value IS NOT NULL AND floor(value / 250) <> 3) SELECT class, count(*) AS n_pixels, {cols(area_km2='sum(k)', fraction='sum(k) / (SELECT sum(k) FROM a)')} FROM a GROUP BY 1")(
    lambda s, d: spatial.area_statistics(spatial.pixel_area(demo.grid_cells(s, d), demo.TOP, demo.STEP).withColumn("class", F.expr("cast(floor(value / 250) as int)")), "class", (3,))
)
RINGS = [[(2.2, 2.2), (35.7, 5.1), (30.3, 44.4), (5.5, 38.8), (2.2, 2.2)], [(12.1, 12.3), (20.4, 12.3), (20.4, 20.6), (12.1, 20.6), (12.1, 12.3)]]
EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for r in RINGS for a, b in zip(r, r[1:]))
add("polygon_mask", f"WITH {demo.CELLS_SQL}, ed(x1, y1, x2, y2) AS (VALUES {EDGES}) SELECT pixel_id, count(*) FILTER ((y1 > row + 0.5) <> (y2 > row + 0.5) AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM ce CROSS JOIN ed GROUP BY 1")(
    lambda s, d: spatial.inside_polygon(demo.grid_cells(s, d).selectExpr("pixel_id", "col + 0.5D as x", "row + 0.5D as y"), spatial.polygon_edges(s, RINGS)).select("pixel_id", "inside")
)
TARGET = "tg AS (SELECT (i // 25)::INTEGER AS row, (i % 25)::INTEGER AS col FROM (SELECT unnest(range(25 * greatest(30, ceil((coalesce(max(row) + 1, 0) - 0.3) / 1.6 - 0.5))::BIGINT)) AS i FROM ce))"


def _target(cells: DataFrame) -> DataFrame:
    """Target cells, 25 in a row, as far as a row's centre is above the grid's end."""
    rows = max(30, math.ceil((_height(cells, 0) - 0.3) / 1.6 - 0.5))
    return cells.sparkSession.range(rows * 25).select(F.expr("cast(id div 25 as int)").alias("row"), F.expr("cast(id % 25 as int)").alias("col"))


def _regridded(s: SparkSession, d: str, method: str) -> DataFrame:
    cells = demo.grid_cells(s, d)
    return spatial.regrid(cells, _target(cells), 1.6, 0.3, method)


def _unflattened(s: SparkSession, d: str) -> DataFrame:
    cells = demo.grid_cells(s, d)
    return spatial.unflatten(cells, _height(cells, 52), 40)


add("regrid_nearest", f"WITH {demo.CELLS_SQL}, {TARGET} SELECT tg.row, tg.col, {cols(value='ce.value')} FROM tg LEFT JOIN ce ON ce.row = floor((tg.row + 0.5) * 1.6 + 0.3) AND ce.col = floor((tg.col + 0.5) * 1.6 + 0.3)")(lambda s, d: _regridded(s, d, "nearest"))
add("regrid_bilinear", f"""WITH {demo.CELLS_SQL}, {TARGET}, pp AS (SELECT row, col, (row + 0.5) * 1.6 + 0.3 - 0.5 AS pr, (col + 0.5) * 1.6 + 0.3 - 0.5 AS pc FROM tg
), cn AS (SELECT pp.row, pp.col, ce.value, (1 - abs(pr - (floor(pr) + a))) * (1 - abs(pc - (floor(pc) + b))) AS w FROM pp CROSS JOIN (VALUES (0), (1)) u(a) CROSS JOIN (VALUES (0), (1)) v(b) LEFT JOIN ce ON ce.row = floor(pr) + a AND ce.col = floor(pc) + b)
SELECT row, col, {cols(value='CASE WHEN sum(w) FILTER (value IS NOT NULL) > 1e-12 THEN sum(w * value) / sum(w) FILTER (value IS NOT NULL) END')} FROM cn GROUP BY 1, 2""")(lambda s, d: _regridded(s, d, "bilinear"))
GA = {"crs": "EPSG:4326", "a": 0.1, "b": 0.0, "c": 90.0, "d": 0.0, "e": -0.1, "f": 26.0, "height": 50, "width": 40}
add("grid_alignment", "SELECT * FROM (VALUES ('same', 0, ''), ('shifted', 3, 'origin,fraction of a pixel,extent'), ('coarse', 3, 'resolution,dimensions,extent')) v(candidate, n_problems, problems)")(
    lambda s, d: s.createDataFrame([(n, len(p := spatial.grid_alignment(GA, GA | c)), ",".join(p)) for n, c in (("same", {}), ("shifted", {"c": 90.05}), ("coarse", {"a": 0.2, "e": -0.2, "height": 25, "width": 25}))], "candidate string, n_problems int, problems string")
)
add("temporal_alignment", "SELECT 83::BIGINT AS n_first, 83::BIGINT AS n_second, 83::BIGINT AS n_differ, true AS second_lags, false AS second_leads, true AS ascending")(
    lambda s, d: spatial.temporal_alignment(windows.monthly_windows(s, 1995, 2001).where("t < 83").select("t", "label"), windows.monthly_windows(s, 1994, 2001).selectExpr("t - 11 as t", "label").where("t between 0 and 82"))
)
add("unflatten", f"WITH {demo.CELLS_SQL} SELECT (i // 40)::INTEGER AS row, (i % 40)::INTEGER AS col, {cols(value='value')} FROM (SELECT unnest(range((40 * greatest(52, max(row) + 1))::BIGINT)) AS i FROM ce) LEFT JOIN ce ON pixel_id = i")(_unflattened)
add("utm_zone", "SELECT c_custkey, (floor(((c_custkey * 7) % 360 - 180 + 180) / 6)::INTEGER % 60 + 1)::INTEGER AS zone FROM customer")(lambda s, d: S.table(s, d, "customer").select("c_custkey", spatial.utm_zone(F.expr("(c_custkey * 7) % 360 - 180")).alias("zone")))

# ---------------------------------------------------------------- joins and ranks

PAIR = f"""{demo.SCENES_SQL}, oli AS (SELECT scene_id, pixel_id, obs_date FROM sc WHERE sensor IN ('LANDSAT8_OLI', 'LANDSAT9_OLI2')), tm AS (SELECT scene_id, pixel_id, obs_date FROM sc WHERE sensor IN ('LANDSAT5_TM', 'LANDSAT7_ETM')
), near AS (SELECT o.scene_id AS left_id, t.scene_id AS right_id, abs(t.obs_date - o.obs_date) AS gap, t.obs_date FROM oli o JOIN tm t ON o.pixel_id = t.pixel_id AND abs(t.obs_date - o.obs_date) <= 45)"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    x = demo.scenes(s, d).withColumn("id", F.col("scene_id"))
    return joins.asof_nearest(x.where("sensor in ('LANDSAT8_OLI', 'LANDSAT9_OLI2')"), x.where("sensor in ('LANDSAT5_TM', 'LANDSAT7_ETM')"), "obs_date", "obs_date", 45, by="pixel_id")


add("asof_sensor_pair", f"WITH {PAIR} SELECT left_id, arg_min(right_id, (gap, obs_date, right_id)) AS right_id, min(gap)::INTEGER AS gap_days FROM near GROUP BY 1")(_pairs)
add("top_scenes_per_year", f"WITH {demo.SCENES_SQL} SELECT year, rank::INTEGER AS rank, scene_id, cloud_cover FROM (SELECT year(obs_date)::INTEGER AS year, row_number() OVER (PARTITION BY year(obs_date) ORDER BY coalesce(cloud_cover, 999), scene_id) AS rank, scene_id, cloud_cover FROM sc) WHERE rank <= 5")(lambda s, d: joins.top_scenes(demo.scenes(s, d), 5))
add("rank_average", f"WITH v AS (SELECT p_partkey, p_size FROM part), c AS (SELECT p_size, count(*) AS n, count(*) AS m FROM v GROUP BY 1) SELECT p_partkey, p_size, {cols(rank='(SELECT coalesce(sum(n), 0) FROM c c2 WHERE c2.p_size > v.p_size) + (c.m + 1) / 2.0')} FROM v JOIN c USING (p_size)")(lambda s, d: joins.rank_average(S.table(s, d, "part").select("p_partkey", "p_size"), "p_size"))
add("run_compare", f"WITH a AS (SELECT o_orderpriority AS quantity, count(*)::DOUBLE AS v FROM orders WHERE year(o_orderdate) = 1996 AND o_orderpriority < '5' GROUP BY 1), b AS (SELECT o_orderpriority AS quantity, count(*)::DOUBLE AS v FROM orders WHERE year(o_orderdate) = 1997 AND o_orderpriority > '2' GROUP BY 1) SELECT quantity, a.v AS before, b.v AS after, b.v - a.v AS change FROM a FULL JOIN b USING (quantity)")(
    lambda s, d: joins.compare_runs(*[S.table(s, d, "orders").where(c).groupBy(F.col("o_orderpriority").alias("quantity")).agg(F.count(F.lit(1)).cast("double").alias("value")) for c in ("year(o_orderdate) = 1996 and o_orderpriority < '5'", "year(o_orderdate) = 1997 and o_orderpriority > '2'")])
)
add("sensor_years", f"WITH {demo.SCENES_SQL} SELECT year(obs_date)::INTEGER AS year, string_agg(DISTINCT sensor, '+' ORDER BY sensor) AS sensors, count(*) AS n_scenes FROM sc GROUP BY 1")(lambda s, d: joins.sensor_years(demo.scenes(s, d)))
add("common_set", f"WITH {demo.METHODS_SQL} SELECT method, pixel_id FROM mf WHERE pixel_id IN (SELECT pixel_id FROM mf WHERE evaluated GROUP BY 1 HAVING count(*) = 3)")(lambda s, d: joins.common_set(demo.method_flags(s, d)).select("method", "pixel_id"))
add("calendar_join", "SELECT c_mktsegment, count(o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = 1998 GROUP BY 1")(
    lambda s, d: S.table(s, d, "customer").join(S.table(s, d, "orders").where("year(o_orderdate) = 1998"), F.expr("o_custkey = c_custkey"), "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"))
)

# ---------------------------------------------------------------- evaluation

PER = f"""{demo.PREDICTIONS_SQL}, cl AS (SELECT truth AS c FROM pr UNION SELECT prediction FROM pr), pc AS (SELECT c, count(*) FILTER (truth = c) AS sup, count(*) FILTER (prediction = c) AS cal, count(*) FILTER (truth = c AND prediction = c) AS hit FROM cl CROSS JOIN pr GROUP BY 1
), pm AS (SELECT *, CASE WHEN cal > 0 THEN hit / cal ELSE 0 END AS p, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS r FROM pc), pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pm)"""
add("confusion_matrix", f"WITH {demo.PREDICTIONS_SQL} SELECT truth, prediction, count(*) AS n FROM pr GROUP BY 1, 2")(lambda s, d: evaluation.confusion(demo.predictions(s, d)))
add("class_metrics", f"WITH {PER} SELECT c AS class, {cols(precision='p', recall='r', f1='f')}, sup AS support, cal AS called, hit FROM pf")(lambda s, d: evaluation.class_metrics(demo.predictions(s, d)))
add("overall_metrics", f"WITH {PER}, k AS (SELECT sum(sup)::DOUBLE AS n, sum(hit) / sum(sup) AS acc, sum(sup * cal) / (sum(sup) * sum(sup)) AS ch FROM pf) SELECT n::BIGINT AS n_samples, {cols(accuracy='acc', cohen_kappa='(acc - ch) / (1 - ch)', precision_macro='(SELECT avg(p) FROM pf)', recall_macro='(SELECT avg(r) FROM pf)', f1_macro='(SELECT avg(f) FROM pf)', precision_weighted='(SELECT sum(p * sup) / sum(sup) FROM pf)', recall_weighted='(SELECT sum(r * sup) / sum(sup) FROM pf)', f1_weighted='(SELECT sum(f * sup) / sum(sup) FROM pf)')} FROM k")(
    lambda s, d: evaluation.overall_metrics(demo.predictions(s, d))
)
add("fold_summary", f"WITH {demo.PREDICTIONS_SQL}, a AS (SELECT fold, avg((truth = prediction)::INTEGER) AS v FROM pr GROUP BY 1) SELECT 'accuracy' AS metric, {cols(mean='avg(v)', std='stddev_pop(v)')}, count(*) AS n_folds FROM a")(lambda s, d: evaluation.fold_summary(demo.predictions(s, d)).where("metric = 'accuracy'"))
PROB = """pb AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: x::DOUBLE * x::DOUBLE) AS v FROM embeddings), pn AS (SELECT vec_id, label, list_transform(v, lambda x: x / list_sum(v)) AS p FROM pb
), un AS (SELECT vec_id, label, p, list_reverse_sort(p)[1] AS conf, list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS mar, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(4) AS ent FROM pn
), uu AS (SELECT *, conf < 0.6 OR mar < 0.15 AS unc FROM un)"""


def _probabilities(s: SparkSession, d: str) -> DataFrame:
    v = S.table(s, d, "embeddings").withColumn("v", F.expr("transform(slice(embedding, 1, 4), x -> cast(x as double) * cast(x as double))"))
    return v.selectExpr("vec_id", "label", "transform(v, x -> x / aggregate(v, 0D, (a, e) -> a + e)) as probabilities")


add("uncertainty", f"WITH {PROB} SELECT vec_id, {cols(confidence='conf', margin='mar', entropy='ent')}, unc AS uncertain FROM uu")(lambda s, d: evaluation.uncertainty(_probabilities(s, d)).select("vec_id", "confidence", "margin", "entropy", "uncertain"))
add("uncertainty_summary", f"WITH {PROB}, z AS (SELECT *, (list_position(p, list_max(p)) = label % 4 + 1)::INTEGER AS ok FROM uu) SELECT count(*) AS n_samples, count(*) FILTER (unc) AS n_uncertain, {cols(uncertain_fraction='avg(unc::INTEGER)', mean_confidence='avg(conf)', median_confidence='median(conf)', mean_margin='avg(mar)', mean_entropy='avg(ent)', accuracy_confident='avg(ok) FILTER (NOT unc)', accuracy_uncertain='avg(ok) FILTER (unc)')}, coalesce(avg(ok) FILTER (NOT unc) > avg(ok) FILTER (unc), false) AS informative FROM z")(
    lambda s, d: evaluation.uncertainty_summary(evaluation.uncertainty(_probabilities(s, d)).withColumns({"truth": F.expr("label % 4 + 1"), "prediction": F.expr("array_position(probabilities, array_max(probabilities))")}))
)
CONF = f"{demo.METHODS_SQL}, cf AS (SELECT method, truth, truth >= 2 AS tgt, count(*) AS n, count(*) FILTER (flagged) AS k FROM mf GROUP BY 1, 2, 3)"
add("confounders", f"WITH {CONF} SELECT method, truth, CASE WHEN tgt THEN 'degradation target' ELSE 'confounder' END AS role, n, k AS n_flagged, {cols(flagged_rate='k / n')} FROM cf")(lambda s, d: evaluation.confounders(demo.method_flags(s, d), [2, 3]))
add("discrimination", f"WITH {CONF}, g AS (SELECT method, sum(k) FILTER (tgt) / sum(n) FILTER (tgt) AS re, sum(k) FILTER (NOT tgt) / sum(n) FILTER (NOT tgt) AS fp, max((k / n, -truth)) FILTER (NOT tgt) AS w FROM cf GROUP BY 1) SELECT method, (-w[2])::INTEGER AS worst_confounder, {cols(recall='re', false_positive_rate='fp', worst_rate='w[1]', margin='re - w[1]')} FROM g")(lambda s, d: evaluation.discrimination(demo.method_flags(s, d), [2, 3]))
add("label_leakage", f"""WITH t AS (SELECT p_size::DOUBLE AS size, p_retailprice AS price, dense_rank() OVER (ORDER BY p_brand)::DOUBLE AS brand_class, dense_rank() OVER (ORDER BY p_brand)::DOUBLE AS code, dense_rank() OVER (ORDER BY p_brand)::DOUBLE AS y FROM part)
SELECT 'size' AS feature, false AS forbidden_name, {O.r6('abs(corr(size, y))')} AS abs_correlation, false AS leaking FROM t UNION ALL SELECT 'price', false, {O.r6('abs(corr(price, y))')}, false FROM t UNION ALL SELECT 'brand_class', true, {O.r6('abs(corr(brand_class, y))')}, true FROM t UNION ALL SELECT 'code', false, {O.r6('abs(corr(code, y))')}, true FROM t""")(
    lambda s, d: evaluation.label_leakage(_leaky(s, d), ["size", "price", "brand_class", "code"], "p_brand")
)


def _leaky(s: SparkSession, d: str) -> DataFrame:
    part = S.table(s, d, "part")
    code = part.select("p_brand").distinct().selectExpr("p_brand", "cast(dense_rank() over (order by p_brand) as double) as code")
    return part.join(F.broadcast(code), "p_brand").selectExpr("p_brand", "cast(p_size as double) as size", "p_retailprice as price", "code as brand_class", "code")


def _history(s: SparkSession) -> Callable[[DataFrame], DataFrame]:
    return lambda cells: _mk(quality.describe(windows.holdout_split(S.to_arrays(cells, 83), 83).where("part = 'history'")).select("pixel_id", "ndvi"))


add("no_lookahead", "SELECT 0::BIGINT AS n_changed")(lambda s, d: evaluation.no_lookahead(_history(s), S.to_long(S.supplier_months(s, d)), 54))
add("welch_step", f"WITH {demo.OBSERVATIONS_SQL}, y AS (SELECT year(obs_date) AS year, avg(value) AS v FROM ob GROUP BY 1), g AS (SELECT avg(v) FILTER (year < 1998) AS a, avg(v) FILTER (year >= 1998) AS b, var_samp(v) FILTER (year < 1998) / count(*) FILTER (year < 1998) + var_samp(v) FILTER (year >= 1998) / count(*) FILTER (year >= 1998) AS e, count(*) AS n FROM y HAVING count(*) FILTER (v IS NOT NULL AND year < 1998) >= 3 AND count(*) FILTER (v IS NOT NULL AND year >= 1998) >= 3) SELECT {cols(step='b - a', error='sqrt(e)', t='(b - a) / sqrt(e)', equivalent_slope='(b - a) / (n / 2)')} FROM g")(
    lambda s, d: evaluation.welch_step(demo.observations(s, d).groupBy(F.year("obs_date").alias("year")).agg(F.avg("value").alias("value")), 1998)
)
add("stratified_sample", f"WITH {demo.PREDICTIONS_SQL} SELECT pixel_id, truth FROM (SELECT pixel_id, truth, row_number() OVER (PARTITION BY truth ORDER BY md5('42:' || pixel_id)) AS r FROM pr) WHERE r <= 20")(lambda s, d: evaluation.stratified_sample(demo.predictions(s, d), "truth", 20).select("pixel_id", "truth"))
add("thin_pixels", "SELECT c_custkey AS pixel_id FROM customer ORDER BY md5('42:' || c_custkey) LIMIT 50")(lambda s, d: evaluation.thin(S.table(s, d, "customer").select(F.col("c_custkey").alias("pixel_id")), 50))

# ---------------------------------------------------------------- without SQL: random draws and fitted models

add("surrogate_test", None)(lambda s, d: models.surrogate_test(S.user_days(s, d), 30))


def _forest_samples(s: SparkSession, d: str) -> DataFrame:
    labelled = demo.supplier_features(s, d).withColumn("label", F.expr("cast(sen < 0 as int)"))
    placed = labelled.withColumns({"row": F.expr("cast(pixel_id div 10 as int)"), "col": F.expr("cast(pixel_id % 10 as int)")})
    return spatial.block_folds(placed, 2, 10, 3)


FOREST = Config().override("forest.n_trees", 30).forest
add("rf_spatial_cv", None)(lambda s, d: models.spatial_cv(_forest_samples(s, d), feature_names(["rainfall", "restrend", "cyclicity"]), "label", 3, FOREST))


from . import study  # noqa: E402, F401  registers its queries here
