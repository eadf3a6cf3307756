"""The feature table: 48 columns of each series without a shuffle after the first.

All estimators are computed in one pass over the rows, so that after the series
are made no data is shuffled or kept, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import kernels as K
from ..functions.batches import packed, with_kernel
from ..operators import breaks, quality, spectral, trend

# Columns by group, in the order of the table.
GROUPS = {
    "vegetation": ["mean", "median_ndvi", "minimum_ndvi", "maximum_ndvi", "std", "cv", "amp", "sen", "ols_slope"],
    "trend": ["mk_z", "mk_p_value", "mk_tau", "mk_significant", "trend_direction"],
    "rainfall": ["rain_mean", "rain_std", "rain_cv", "rain_sen", "rain_ndvi_correlation"],
    "restrend": ["restrend", "restrend_p_value", "restrend_r2", "restrend_beta", "restrend_valid", "restrend_significant"],
    "cyclicity": ["cyc_score", "cyc_enrichment", "cyc_period", "cyc_band_power", "cyc_total_power", "cyclicity_periodic"],
    "disturbance": ["has_break", "break_t", "break_dslope", "break_gain", "breakpoint_index", "breakpoint_significant", "pre_breakpoint_level", "post_breakpoint_minimum", "disturbance_magnitude"],
    "recovery": ["has_disturbance", "recovery_magnitude", "recovery_fraction", "recovery_duration", "recovery_slope", "recovery_status"],
    "diagnostic": ["n_valid_ndvi", "n_valid_pairs"],
}


def feature_names(groups: list[str] | None = None) -> list[str]:
    """The columns of some groups, in the table's order; unknown groups raise."""
    unknown = [g for g in groups or [] if g not in GROUPS]
    if unknown:
        raise ValueError(f"unknown feature groups {unknown}")
    return [c for g, cs in GROUPS.items() if groups is None or g in groups for c in cs]


def feature_dictionary(spark) -> DataFrame:
    return spark.createDataFrame([(c, g, i) for i, (c, g) in enumerate((c, g) for g, cs in GROUPS.items() for c in cs)], "feature string, grp string, position int")


def estimates(series: DataFrame, n_time: int, cfg: Config | None = None) -> DataFrame:
    """The series with the structs of all estimators: mk, hr, fit, cyc, brk, rec,
    ndvi_stats, rain_stats, and the scalars sen, ols_slope, rain_sen, correlation.

    One pass over Arrow batches computes them all.
    """
    cfg = cfg or Config()
    t = cfg.trend
    least, ties, correct = t.min_obs, t.apply_ties_correction, t.apply_autocorrelation_correction
    last, level = trend.last_lag(n_time, t), t.hr_significance_level
    fit, cycle, cut, back = trend.restrend_kernel(cfg.restrend), spectral.kernel(n_time, cfg.cyclicity), breaks.break_kernel(cfg.breakpoint), breaks.recovery_kernel(cfg.recovery)
    structs = {"mk": trend.MK, "hr": trend.HR, "fit": trend.RESTREND, "cyc": spectral.CYC, "brk": breaks.BRK, "rec": breaks.REC, "ndvi_stats": quality.STATS, "rain_stats": quality.STATS}
    scalars = ["sen", "ols_slope", "rain_sen", "correlation"]
    made = {(s, f): f"__{s}_{f}" for s, fields in structs.items() for f in fields}

    def kernel(x, r):
        mk = K.mann_kendall(x, least, ties)
        ratio = K.rank_autocorrelation(x, mk["any_sen"], last, level)["ratio"] if correct else None
        brk = cut(x)
        got = {
            "mk": mk, "hr": K.corrected(mk["s"], mk["var"], ratio) if correct else {"z": mk["z"], "p": mk["p"], "ratio": mk["z"] * 0 + 1},
            "fit": fit(x, r), "cyc": cycle(x), "brk": brk, "rec": back(x, brk["index"]), "ndvi_stats": K.describe(x), "rain_stats": K.describe(r),
        }
        flat = {made[s, f]: v for s, fields in got.items() for f, v in fields.items() if (s, f) in made}
        return flat | {"sen": mk["sen"], "ols_slope": K.ols_slope(x)["slope"], "rain_sen": K.sens_slope(r, least)["sen"], "correlation": K.pearson(x, r, 3)["r"]}

    df = with_kernel(series, ["ndvi", "rain"], [*made.values(), *scalars], kernel)
    for s, fields in structs.items():
        df = packed(df, s, fields, {f: made[s, f] for f in fields})
    return df


def feature_table(series: DataFrame, n_time: int, cfg: Config | None = None) -> DataFrame:
    """pixel_id and the 48 feature columns as doubles.

    A descriptor that is undefined because there is no break or no disturbance
    is 0, next to its indicator; what is unknown is null.
    """
    cfg = cfg or Config()
    df = estimates(series, n_time, cfg)
    yes = lambda c: f"if({c}, 1D, 0D)"
    at_break = lambda c: f"if(brk.index >= 0, coalesce({c}, 0D), 0D)"
    disturbed = f"rec.status <> {breaks.NONE}"
    at_drop = lambda c: f"if({disturbed}, coalesce({c}, 0D), 0D)"
    columns = {
        "mean": "ndvi_stats.mean", "median_ndvi": "ndvi_stats.median", "minimum_ndvi": "ndvi_stats.min", "maximum_ndvi": "ndvi_stats.max",
        "std": "ndvi_stats.std", "cv": "ndvi_stats.cv", "amp": "ndvi_stats.amp", "sen": "sen", "ols_slope": "ols_slope",
        "mk_z": "hr.z", "mk_p_value": "hr.p", "mk_tau": "mk.tau", "mk_significant": yes(f"coalesce(hr.p < {cfg.trend.alpha}, false)"), "trend_direction": "signum(sen)",
        "rain_mean": "rain_stats.mean", "rain_std": "rain_stats.std", "rain_cv": "rain_stats.cv", "rain_sen": "rain_sen", "rain_ndvi_correlation": "correlation",
        "restrend": "fit.slope", "restrend_p_value": "fit.p", "restrend_r2": "fit.r2", "restrend_beta": "fit.beta", "restrend_valid": yes("fit.valid"),
        "restrend_significant": yes(f"coalesce(fit.p < {cfg.restrend.alpha}, false) and fit.valid"),
        "cyc_score": "cyc.score", "cyc_enrichment": "cyc.enrichment", "cyc_period": "coalesce(cyc.period, 0D)", "cyc_band_power": "cyc.band_power", "cyc_total_power": "cyc.total_power", "cyclicity_periodic": yes("cyc.periodic"),
        "has_break": yes("brk.index >= 0"), "break_t": at_break(f"brk.index / {n_time}D"), "break_dslope": at_break("brk.delta_slope"), "break_gain": at_break("brk.gain"),
        "breakpoint_index": "cast(brk.index as double)", "breakpoint_significant": yes("brk.significant"), "pre_breakpoint_level": at_break("rec.pre_level"), "post_breakpoint_minimum": at_break("rec.trough_value"),
        "disturbance_magnitude": at_drop("rec.disturbance_magnitude"), "has_disturbance": yes(disturbed), "recovery_magnitude": at_drop("rec.recovery_magnitude"), "recovery_fraction": at_drop("rec.recovery_fraction"),
        "recovery_duration": at_drop("rec.recovery_duration"), "recovery_slope": at_drop("rec.recovery_slope"), "recovery_status": "cast(rec.status as double)",
        "n_valid_ndvi": "cast(ndvi_stats.n as double)", "n_valid_pairs": "cast(fit.n as double)",
    }
    return df.select("pixel_id", *[F.expr(columns[c]).alias(c) for c in feature_names()])
