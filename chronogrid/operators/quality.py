"""Which series can be analysed, and what their gaps look like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Section, defaults
from ..functions import kernels as K
from ..functions.arrays import total
from ..functions.batches import add_struct
from ..series import sealed

OK, INSUFFICIENT_OBS, TOO_MANY_MISSING, CONSTANT, OUT_OF_RANGE = range(5)
FLAG_NAMES = {0: "OK", 1: "INSUFFICIENT_OBS", 2: "TOO_MANY_MISSING", 3: "CONSTANT", 4: "OUT_OF_RANGE"}


def sanitize(df: DataFrame, x: str = "ndvi", cfg: Section | None = None) -> DataFrame:
    """Values outside the physical range become null."""
    cfg = cfg or defaults("quality")
    return df.withColumn(x, F.expr(f"transform({x}, e -> if(e between {cfg.ndvi_min}D and {cfg.ndvi_max}D, e, null))"))


def assess(df: DataFrame, n_time: int, x: str = "ndvi", out: str = "quality", cfg: Section | None = None) -> DataFrame:
    """Adds a struct valid_count, missing_fraction, variance, flag, after
    sanitizing; the most fundamental failure names the flag."""
    cfg = cfg or defaults("quality")
    df = sanitize(df.withColumn("_x", F.col(x)), "_x", cfg).withColumn("_v", F.expr("filter(_x, e -> e is not null)"))
    df = df.withColumn("_n", F.expr("size(_v)")).withColumn("_m", F.expr(f"{total('_v', 'p')} / _n"))
    df = df.withColumn("_var", F.expr(f"if(_n = 0, 0D, {total('_v', '(p - _m) * (p - _m)')} / _n)"))
    df = df.withColumn("_miss", F.expr(f"1 - _n / {n_time}D"))
    flag = f"""case when _n = 0 then {OUT_OF_RANGE} when _n < {cfg.min_valid_obs} then {INSUFFICIENT_OBS}
      when _miss > {cfg.max_missing_fraction}D then {TOO_MANY_MISSING} when _var < {cfg.min_variance}D then {CONSTANT} else {OK} end"""
    df = df.withColumn(out, F.struct(F.col("_n").alias("valid_count"), F.col("_miss").alias("missing_fraction"), F.col("_var").alias("variance"), F.expr(flag).alias("flag")))
    return df.drop("_x", "_v", "_n", "_m", "_var", "_miss")


def usable(df: DataFrame, n_time: int, x: str = "ndvi", cfg: Section | None = None) -> DataFrame:
    """The series that pass the gate."""
    return sealed(assess(df, n_time, x, "_q", cfg)).where(f"_q.flag = {OK}").drop("_q")


def summary(assessed: DataFrame, col: str = "quality") -> DataFrame:
    """flag, name, n_pixels for every flag, zeros included."""
    spark = assessed.sparkSession
    names = spark.createDataFrame(list(FLAG_NAMES.items()), "flag int, name string")
    counts = assessed.groupBy(F.col(f"{col}.flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "flag", "left").select("flag", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n_pixels"))


def gap_runs(long: DataFrame, x: str = "ndvi") -> DataFrame:
    """pixel_id, start, end, length, interior of every run of missing steps; a
    run at either end of the record is not interior."""
    steps = long.withColumn("ends", F.struct(F.col("t").alias("t")))
    missing = long.where(F.col(x).isNull()).selectExpr("pixel_id", "t", "t - row_number() over (partition by pixel_id order by t) as island")
    runs = missing.groupBy("pixel_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("length"))
    seen = steps.where(F.col(x).isNotNull()).groupBy("pixel_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    inside = F.coalesce((F.col("start") > F.col("first")) & (F.col("end") < F.col("last")), F.lit(False))
    return runs.join(seen, "pixel_id", "left").select("pixel_id", "start", "end", "length", inside.alias("interior"))


def fill_gaps(df: DataFrame, n_time: int, x: str = "ndvi", cfg: Section | None = None) -> DataFrame:
    """Interior gaps of at most max_interpolation_gap steps, filled linearly; adds
    n_filled.  Ends are never extrapolated."""
    cfg = cfg or defaults("quality")
    df = df.withColumn("_v", F.expr(f"filter(transform({x}, (e, i) -> named_struct('t', i, 'x', e)), p -> p.x is not null)"))
    near = "named_struct('a', array_max(filter(_v, p -> p.t < i)), 'b', array_min(filter(_v, p -> p.t > i)))"
    df = df.withColumn("_near", F.expr(f"transform({x}, (e, i) -> if(e is not null, null, {near}))"))
    filled = f"""transform({x}, (e, i) -> if(e is null and _near[i].a is not null and _near[i].b is not null and _near[i].b.t - _near[i].a.t - 1 <= {cfg.max_interpolation_gap},
      _near[i].a.x + (_near[i].b.x - _near[i].a.x) * (i - _near[i].a.t) / (_near[i].b.t - _near[i].a.t), e))"""
    df = df.withColumn("_f", F.expr(filled))
    holes = lambda c: f"size(filter({c}, e -> e is null))"
    return df.withColumn("n_filled", F.expr(f"{holes(x)} - {holes('_f')}")).withColumn(x, F.col("_f")).drop("_v", "_near", "_f")


STATS = {"n": "int", "mean": "double", "std": "double", "cv": "double", "amp": "double", "median": "double", "min": "double", "max": "double"}


def describe(df: DataFrame, x: str = "ndvi") -> DataFrame:
    """Adds a struct of descriptive statistics of the observed values: n, mean,
    std (of the population), cv, amp (95th less 5th percentile), median, min, max."""
    return add_struct(df, [x], f"{x}_stats", STATS, K.describe)


def describe_all(long: DataFrame, *names: str) -> DataFrame:
    """One row for each variable over all cells: counts, range, mean, spread."""
    rows = long.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).alias("v")) for n in names])).alias("r")).select("r.*")
    q = lambda p: F.percentile("v", F.lit(p))
    return rows.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) - F.count("v")).alias("n_missing"), (1 - F.count("v") / F.count(F.lit(1))).alias("missing_fraction"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), q(0.5).alias("median"), F.stddev_pop("v").alias("std"), q(0.05).alias("p05"), q(0.95).alias("p95"),
    )


def step_stats(long: DataFrame) -> DataFrame:
    """t, mean, p10, p90, valid_fraction, rain_mean of each step."""
    return long.groupBy("t").agg(
        F.avg("ndvi").alias("mean"), F.percentile("ndvi", F.lit(0.1)).alias("p10"), F.percentile("ndvi", F.lit(0.9)).alias("p90"),
        (F.count("ndvi") / F.count(F.lit(1))).alias("valid_fraction"), F.avg("rain").alias("rain_mean"),
    )


def availability_trend(long: DataFrame) -> DataFrame:
    """One row: the line through the share of observed cells by step; null where
    that share does not vary."""
    share = long.groupBy("t").agg((F.count("ndvi") / F.count(F.lit(1))).alias("a"))
    got = share.agg(F.regr_slope("a", "t").alias("s"), F.regr_intercept("a", "t").alias("i"), F.corr("a", "t").alias("c"), F.stddev_pop("a").alias("d"), F.count(F.lit(1)).alias("n"))
    fine = (F.col("n") >= 3) & (F.col("d") > 0)
    return got.select(F.when(fine, F.col("s")).alias("slope_per_step"), F.when(fine, F.col("i")).alias("intercept"), F.when(fine, F.col("c")).alias("correlation_with_time"))


def validate(long: DataFrame, cfg: Section | None = None) -> DataFrame:
    """One row of checks over all cells: counts, range, values out of range."""
    cfg = cfg or defaults("quality")
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return long.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("pixel_id").alias("n_pixels"), F.count_distinct("t").alias("n_time"), bad(F.col("ndvi").isNull()).alias("n_missing"),
        F.min("ndvi").alias("ndvi_min"), F.max("ndvi").alias("ndvi_max"), bad(~F.col("ndvi").between(cfg.ndvi_min, cfg.ndvi_max)).alias("n_out_of_range"), bad(F.col("rain") < 0).alias("n_negative_rain"),
    )
