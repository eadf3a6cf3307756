"""Monotonic and linear trend of each series.

Each estimator adds columns in one pass over Arrow batches; no data moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Section, defaults
from ..functions import kernels as K
from ..functions.batches import add_struct, with_kernel

#: Fields of the Mann-Kendall, corrected and climate-adjusted results.
MK = {"n": "int", "s": "double", "var": "double", "z": "double", "p": "double", "tau": "double"}
HR = {"z": "double", "p": "double", "ratio": "double"}
RESTREND = {"n": "int", "slope": "double", "p": "double", "r2": "double", "beta": "double", "beta_p": "double", "valid": "boolean"}


def last_lag(n_time: int, cfg: Section) -> int:
    return max(1, int(n_time * cfg.hr_max_lag_fraction))


def sens_slope(df: DataFrame, x: str = "ndvi", out: str = "sen", min_obs: int = 10) -> DataFrame:
    """Theil-Sen slope: the median of pairwise slopes; null below min_obs points."""
    return with_kernel(df, [x], [out], lambda m: {out: K.sens_slope(m, min_obs)["sen"]})


def mann_kendall(df: DataFrame, x: str = "ndvi", out: str = "mk", min_obs: int = 10, ties: bool = True) -> DataFrame:
    """Adds a struct n, s, var, z, p, tau.

    S counts rising less falling pairs; the variance allows for ties; z has the
    continuity correction and is 0 for S = 0, whatever the variance.  All but n
    and s are null below min_obs points.
    """
    return add_struct(df, [x], out, MK, lambda m: K.mann_kendall(m, min_obs, ties))


def hamed_rao(df: DataFrame, n_time: int, x: str = "ndvi", mk: str = "mk", out: str = "hr", cfg: Section | None = None) -> DataFrame:
    """Adds a struct z, p, ratio: Mann-Kendall with the variance scaled for the
    significant autocorrelation of the ranks of the detrended series.

    Ties of detrended values rank by time.  Lags run to a fraction of the record
    length; weights and bounds use the number of points.
    """
    cfg = cfg or defaults("trend")
    last, level = last_lag(n_time, cfg), cfg.hr_significance_level

    def kernel(m, s, var):
        slope = K.sens_slope(m, 0)["sen"]
        return K.corrected(s, var, K.rank_autocorrelation(m, slope, last, level)["ratio"])

    flat = df.withColumns({"__s": F.col(mk)["s"], "__var": F.col(mk)["var"]})
    return add_struct(flat, [x, "__s", "__var"], out, HR, kernel).drop("__s", "__var")


def ols_slope(df: DataFrame, x: str = "ndvi", out: str = "ols_slope") -> DataFrame:
    """Least-squares slope on time of at least two points."""
    return with_kernel(df, [x], [out], lambda m: {out: K.ols_slope(m)["slope"]})


def pearson(df: DataFrame, x: str = "ndvi", y: str = "rain", out: str = "correlation", min_pairs: int = 3) -> DataFrame:
    """Correlation over the steps where both are observed."""
    return with_kernel(df, [x, y], [out], lambda a, b: {out: K.pearson(a, b, min_pairs)["r"]})


def restrend_kernel(cfg: Section):
    if cfg.method not in ("joint", "two_stage"):
        raise ValueError("method must be 'joint' or 'two_stage'")
    joint, least, r2, alpha, positive = cfg.method == "joint", cfg.min_obs, cfg.min_r2, cfg.alpha, cfg.require_positive_beta
    return lambda x, r: K.restrend(x, r, joint, least, r2, alpha, positive)


def restrend(df: DataFrame, x: str = "ndvi", r: str = "rain", out: str = "restrend", cfg: Section | None = None) -> DataFrame:
    """Adds a struct n, slope, p, r2, beta, beta_p, valid: the trend that is left
    when the covariate is accounted for.

    ``joint`` fits covariate and time together, and r2 is the covariate's partial
    one; ``two_stage`` fits time to the residuals of the covariate fit.  valid
    says whether the covariate relation is strong enough to adjust for at all.
    """
    return add_struct(df, [x, r], out, RESTREND, restrend_kernel(cfg or defaults("restrend")))


def sen_line(df: DataFrame, x: str = "ndvi", out: str = "line") -> DataFrame:
    """Adds an array: the Theil-Sen line through the medians of time and value,
    at every step; null without two points."""
    df = with_kernel(df, [x], ["__slope"], lambda m: {"__slope": K.sens_slope(m, 2)["sen"]})
    v = f"sort_array(filter({x}, e -> e is not null))"
    t = f"filter(transform({x}, (e, i) -> if(e is null, null, cast(i as double))), i -> i is not null)"
    mid = lambda a: f"((element_at({a}, cast((size({a}) + 1) div 2 as int)) + element_at({a}, cast(size({a}) div 2 + 1 as int))) / 2)"
    df = df.withColumns({"__v": F.expr(v), "__t": F.expr(t)})
    line = f"if(__slope is null, null, transform({x}, (e, i) -> {mid('__v')} + __slope * (i - {mid('__t')})))"
    return df.withColumn(out, F.expr(line)).drop("__slope", "__v", "__t")


def restrend_residuals(df: DataFrame, x: str = "ndvi", r: str = "rain", out: str = "residual", least: int = 4) -> DataFrame:
    """Adds an array: what covariate and time leave of each step of the series,
    by least squares; null at unobserved steps and below ``least`` pairs."""
    fields = {"n": "double", "slope": "double", "beta": "double"}
    df = add_struct(df, [x, r], "__f", fields, lambda a, b: K.restrend(a, b, True, least, 0.0, 1.0, False))
    pairs = f"filter(transform({x}, (e, i) -> named_struct('t', i, 'x', e, 'y', get({r}, i))), p -> p.x is not null and p.y is not null)"
    df = df.withColumn("__p", F.expr(pairs))
    mean = lambda k: f"aggregate(__p, 0D, (a, p) -> a + p.{k}) / size(__p)"
    df = df.withColumns({f"__m{k}": F.expr(mean(k)) for k in "txy"})
    left = f"transform({x}, (e, i) -> e - __mx - __f.beta * (get({r}, i) - __my) - __f.slope * (i - __mt))"
    return df.withColumn(out, F.expr(f"if(__f.beta is null, null, {left})")).drop("__f", "__p", "__mt", "__mx", "__my")
