"""Trajectory classes and decision rules over the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config

UNCERTAIN = "Uncertain / Other"
CODES = {"Stable": 1, "Degrading": 2, "Rainfall-associated decline": 3, "Disturbed": 4, "Recovering": 5, "Cyclic": 6, UNCERTAIN: 7}


def _sql(condition: str) -> str:
    """A condition in which a null comparison is false."""
    return f"coalesce({condition}, false)"


def conditions(cfg: Config) -> dict[str, str]:
    """SQL of each class's rule, before priorities."""
    t, alpha = cfg.trajectory, cfg.trend.alpha
    significant = _sql(f"mk_p_value < {alpha}")
    falling = _sql("sen < 0") + (f" and {significant}" if t.require_trend_significance else "")
    survives = _sql(f"restrend_p_value < {alpha} and restrend < 0")
    explained = f"({falling} and restrend_valid > 0 and not {survives})" if t.require_climate_adjustment else "false"
    degrading = f"({falling} and not {explained})"
    cyclic = _sql(f"cyc_enrichment >= {cfg.cyclicity.periodicity_threshold}") + (" and cyclicity_periodic > 0" if t.require_periodic_flag else "")
    dropped = f"has_disturbance > 0 and disturbance_magnitude >= {cfg.recovery.min_disturbance_magnitude}" + (" and breakpoint_significant > 0" if t.require_significant_breakpoint else "")
    back = f"({dropped} and recovery_fraction >= {t.recovery_fraction_threshold})"
    gone = f"({dropped} and not recovery_fraction >= {t.recovery_fraction_threshold})"
    rising = f"({_sql('sen > 0')} and {significant})"
    stable = f"not ({degrading} or {explained} or ({cyclic}) or {back} or {gone} or {rising})"
    return {"Degrading": degrading, "Rainfall-associated decline": explained, "Cyclic": f"({cyclic})", "Recovering": back, "Disturbed": gone, "Stable": stable}


def classify(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Adds trajectory and its code: the first class of the priority list whose
    rule holds; uncertain where mean, slope or z are unknown or no rule holds."""
    cfg = cfg or Config()
    unknown = [c for c in cfg.trajectory.priority if c not in CODES]
    if unknown:
        raise ValueError(f"unknown classes in priority: {unknown}")
    rules = conditions(cfg)
    cases = " ".join(f"when {rules[c]} then '{c}'" for c in cfg.trajectory.priority if c in rules)
    label = f"case when mean is null or sen is null or mk_z is null then '{UNCERTAIN}' {cases} else '{UNCERTAIN}' end"
    code = "case trajectory " + " ".join(f"when '{c}' then {k}" for c, k in CODES.items()) + " end"
    return features.withColumn("trajectory", F.expr(label)).withColumn("trajectory_code", F.expr(code))


def summary(classified: DataFrame) -> DataFrame:
    """trajectory, code, n_pixels, fraction for every class, zeros included."""
    names = classified.sparkSession.createDataFrame(list(CODES.items()), "trajectory string, code int")
    n = classified.groupBy("trajectory").agg(F.count(F.lit(1)).alias("n"))
    total = classified.agg(F.count(F.lit(1)).alias("total"))
    return names.join(n, "trajectory", "left").join(F.broadcast(total)).select(
        "trajectory", "code", F.coalesce("n", F.lit(0)).alias("n_pixels"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction")
    )


def baselines(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """pixel_id and flag and score of three fixed rules: the plain trend, the
    trend that survives climate adjustment, and that without cycles and recovered
    drops."""
    cfg = cfg or Config()
    alpha = cfg.trend.alpha
    falling = _sql(f"mk_p_value < {alpha} and sen < 0")
    kept = f"({falling} and ({_sql(f'restrend_p_value < {alpha} and restrend < 0')} or not restrend_valid > 0))"
    cyclic = f"(cyclicity_periodic > 0 and {_sql(f'cyc_enrichment >= {cfg.cyclicity.periodicity_threshold}')})"
    healed = f"(has_disturbance > 0 and recovery_fraction >= {cfg.trajectory.recovery_fraction_threshold})"
    final = f"({kept} and not {cyclic} and not {healed})"
    half = lambda p, default: f"least(greatest(coalesce({p}, {default}) / 2, 0D), 0.5D)"
    adjusted = f"if({kept}, 1 - coalesce(restrend_p_value, 0.5D), {half('mk_p_value', '1D')})"
    columns = {
        "trend_flag": f"cast({falling} as int)",
        "trend_score": f"if(mk_p_value is null, 0.5D, if({falling}, 1 - mk_p_value, {half('mk_p_value', '1D')}))",
        "restrend_flag": f"cast({kept} as int)",
        "restrend_score": adjusted,
        "integrated_flag": f"cast({final} as int)",
        "integrated_score": f"if({final}, {adjusted}, least({adjusted}, 0.5D))",
    }
    return features.select("pixel_id", *[F.expr(e).alias(c) for c, e in columns.items()])


def productivity(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """One row: percentages of declining, stable, increasing among the assessed."""
    alpha = (cfg or Config()).trend.alpha
    known = features.where("mk_p_value is not null and sen is not null")
    share = lambda c: (100 * F.sum(F.expr(f"if({c}, 1, 0)")) / F.count(F.lit(1)))
    down, up = f"mk_p_value < {alpha} and sen < 0", f"mk_p_value < {alpha} and sen > 0"
    return known.agg(share(down).alias("pct_declining"), share(f"not ({down}) and not ({up})").alias("pct_stable"), share(up).alias("pct_increasing"), F.count(F.lit(1)).alias("n_assessed"))


def restrend_categories(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """category, n_pixels, fraction: five disjoint readings of trend and adjustment."""
    alpha = (cfg or Config()).trend.alpha
    label = f"""case when {_sql(f'mk_p_value < {alpha} and sen < 0')} then
        case when not restrend_valid > 0 then 'decline_not_adjustable_weak_rainfall_relation'
             when {_sql(f'restrend_p_value < {alpha} and restrend < 0')} then 'decline_persists_after_climate_adjustment'
             else 'decline_largely_explained_by_rainfall' end
      when {_sql(f'mk_p_value < {alpha} and sen > 0')} then 'significant_increase' else 'stable_or_no_significant_trend' end"""
    total = features.agg(F.count(F.lit(1)).alias("total"))
    return features.groupBy(F.expr(label).alias("category")).agg(F.count(F.lit(1)).alias("n_pixels")).join(F.broadcast(total)).select("category", "n_pixels", (F.col("n_pixels") / F.col("total")).alias("fraction"))


def exclusion_reasons(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """reason, n_pixels: why the covariate relation of a series is not valid."""
    r = (cfg or Config()).restrend
    few, weak, wrong = f"n_valid_ndvi < {r.min_obs}", _sql(f"restrend_r2 < {r.min_r2}"), _sql("restrend_beta <= 0")
    reasons = {
        "insufficient_valid_observations": few, "rainfall_relation_too_weak": f"{weak} and not {few}",
        "rainfall_sensitivity_not_positive": f"{wrong} and not {weak} and not {few}", "regression_not_estimable": "restrend_r2 is null",
    }
    one = features.where("not restrend_valid > 0").agg(*[F.coalesce(F.sum(F.expr(f"if({c}, 1, 0)")), F.lit(0)).cast("long").alias(k) for k, c in reasons.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("n_pixels")) for k in reasons])).alias("r")).select("r.*")


def agreement(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """pixel_id, agreeing (0 to 3 indicators of decline), ambiguous, thin."""
    cfg = cfg or Config()
    alpha = cfg.trend.alpha
    signs = [_sql(f"mk_p_value < {alpha} and sen < 0"), f"(restrend_valid > 0 and {_sql(f'restrend_p_value < {alpha} and restrend < 0')})", "breakpoint_significant > 0"]
    counted = features.withColumn("agreeing", F.expr(" + ".join(f"cast({s} as int)" for s in signs)))
    return counted.select("pixel_id", "agreeing", F.expr("agreeing = 1 or (cyclicity_periodic > 0 and agreeing >= 1)").alias("ambiguous"), F.expr(f"n_valid_ndvi < {cfg.quality.min_valid_obs + 3}").alias("thin"))


def reassignment(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """trend_flag, trajectory, n_pixels: where the plain rule's calls end up."""
    flags = baselines(features, cfg).select("pixel_id", "trend_flag")
    return classify(features, cfg).join(flags, "pixel_id").groupBy("trend_flag", "trajectory").agg(F.count(F.lit(1)).alias("n_pixels"))


def uncertain_composition(features: DataFrame, cfg: Config | None = None) -> DataFrame:
    """One row: how much of the uncertain class is significant greening."""
    alpha = (cfg or Config()).trend.alpha
    green = _sql(f"mk_p_value < {alpha} and sen > 0")
    named = classify(features, cfg)
    n = lambda c: F.sum(F.expr(f"if({c}, 1, 0)")).cast("long")
    unsure = f"trajectory = '{UNCERTAIN}'"
    return named.agg(n(unsure).alias("n_uncertain"), n(f"{unsure} and {green}").alias("n_greening"), n(f"{unsure} and not {green}").alias("n_unmatched"), (n(unsure) / F.count(F.lit(1))).alias("fraction"))


def condition_areas(features: DataFrame, cell_km2: float, cfg: Config | None = None) -> DataFrame:
    """condition, n_pixels, area_km2 of seven conditions that may overlap."""
    alpha = (cfg or Config()).trend.alpha
    significant = _sql(f"mk_p_value < {alpha}")
    named = {
        "significant_decline": f"{significant} and {_sql('sen < 0')}", "significant_increase": f"{significant} and {_sql('sen > 0')}", "no_significant_trend": f"not {significant}",
        "climate_adjusted_decline": f"restrend_valid > 0 and {_sql(f'restrend_p_value < {alpha} and restrend < 0')}", "cyclic_signal": "cyclicity_periodic > 0",
        "disturbance_detected": "has_disturbance > 0", "recovering_after_disturbance": "recovery_status = 2",
    }
    one = features.agg(*[F.sum(F.expr(f"if({c}, 1, 0)")).cast("long").alias(k) for k, c in named.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.col(k).alias("n_pixels")) for k in named])).alias("r")).select("r.*")
    return rows.withColumn("area_km2", F.col("n_pixels") * cell_km2)
