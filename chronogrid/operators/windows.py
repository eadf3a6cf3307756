"""Composite windows, and irregular observations brought onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Season, first and last month-day; December is outside all of them.
SEASONS = (("DJF", "01-01", "02-28"), ("MAM", "03-01", "05-31"), ("JJA", "06-01", "08-31"), ("SON", "09-01", "11-30"))
STATISTICS = ("median", "mean", "max", "min", "percentile")


def _years(spark: SparkSession, first: int, last: int) -> DataFrame:
    if last < first:
        raise ValueError(f"year {last} is before {first}")
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def annual_windows(spark: SparkSession, first: int, last: int, start: str = "10-15", end: str = "12-31") -> DataFrame:
    """t, label, start, end (inclusive), year; a window that would end before its
    start closes in the next year and keeps its opening year's label."""
    years = _years(spark, first, last)
    close = F.col("year") + (1 if end < start else 0)
    return years.select(
        (F.col("year") - first).alias("t"), F.col("year").cast("string").alias("label"), F.to_date(F.concat_ws("-", "year", F.lit(start))).alias("start"),
        F.to_date(F.concat_ws("-", close.cast("string"), F.lit(end))).alias("end"), "year",
    )


def seasonal_windows(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Four windows a year."""
    seasons = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (n, a, b) in enumerate(SEASONS)]))
    day = lambda c: F.to_date(F.concat_ws("-", "year", c))
    return _years(spark, first, last).withColumn("s", seasons).select(
        ((F.col("year") - first) * 4 + F.col("s.i")).alias("t"), F.concat_ws("-", "year", "s.n").alias("label"), day("s.a").alias("start"), day("s.b").alias("end"), "year"
    )


def monthly_windows(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Twelve windows a year."""
    months = _years(spark, first, last).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("start", F.make_date("year", "m", F.lit(1)))
    return months.select(((F.col("year") - first) * 12 + F.col("m") - 1).alias("t"), F.date_format("start", "yyyy-MM").alias("label"), "start", F.last_day("start").alias("end"), "year")


def build_windows(spark: SparkSession, unit: str, first: int, last: int, start: str = "10-15", end: str = "12-31") -> DataFrame:
    if unit == "annual":
        return annual_windows(spark, first, last, start, end)
    if unit in ("seasonal", "monthly"):
        return {"seasonal": seasonal_windows, "monthly": monthly_windows}[unit](spark, first, last)
    raise ValueError(f"unknown unit {unit!r}")


def composite(observations: DataFrame, windows: DataFrame, statistic: str = "median", percentile: float = 90.0, min_observations: int = 1) -> DataFrame:
    """pixel_id, t, value, n_valid, n_masked for every pixel and window.

    Observations (pixel_id, scene_id, obs_date, value) fall into a window whose
    start and end enclose their date; a null value was masked.  Windows are few
    (their number is that of time steps) and are broadcast; the range join is
    then a filter, and the aggregation the only shuffle.  A scene without a row
    for a pixel counts as masked there.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic!r}")
    value = {
        "median": F.percentile("value", F.lit(0.5)), "mean": F.avg("value"), "max": F.max("value"), "min": F.min("value"),
        "percentile": F.percentile("value", F.lit(percentile / 100)),
    }[statistic]
    w = F.broadcast(windows.select("t", "start", "end"))
    inside = observations.join(w, F.col("obs_date").between(F.col("start"), F.col("end")))
    scenes = window_scenes(observations, windows)
    got = inside.groupBy("pixel_id", "t").agg(value.alias("value"), F.count("value").alias("n_valid"))
    grid = observations.select("pixel_id").distinct().join(F.broadcast(scenes))
    need = max(min_observations, 1)
    return grid.join(got, ["pixel_id", "t"], "left").select(
        "pixel_id", "t", F.when(F.col("n_valid") >= need, F.col("value")).alias("value"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
        (F.col("n_scenes") - F.coalesce("n_valid", F.lit(0))).alias("n_masked"),
    )


def window_scenes(observations: DataFrame, windows: DataFrame) -> DataFrame:
    """t, n_scenes: scenes dated in each window, empty windows included."""
    dated = observations.select("scene_id", "obs_date").distinct()
    inside = dated.join(F.broadcast(windows.select("t", "start", "end")), F.col("obs_date").between(F.col("start"), F.col("end")))
    counts = inside.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return windows.select("t").join(counts, "t", "left").select("t", F.coalesce("n", F.lit(0)).alias("n_scenes"))


def composite_summary(composites: DataFrame) -> DataFrame:
    """t, missing_fraction, mean_valid, mean_masked, empty of each step."""
    return composites.groupBy("t").agg(
        (1 - F.count("value") / F.count(F.lit(1))).alias("missing_fraction"), F.avg("n_valid").alias("mean_valid"), F.avg("n_masked").alias("mean_masked"),
        (F.count("value") == 0).alias("empty"),
    )


def rain_ranges(windows: DataFrame, accumulation: str = "hydrological_year") -> DataFrame:
    """t, lo, hi: the dates whose rain belongs to each window."""
    lo, hi = {
        "hydrological_year": (F.date_sub("end", 364), F.col("end")),
        "calendar_year": (F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))),
        "window": (F.col("start"), F.col("end")),
    }[accumulation]
    return windows.select("t", lo.alias("lo"), hi.alias("hi"))


def accumulate_rain(rain: DataFrame, windows: DataFrame, accumulation: str = "hydrological_year", min_coverage: float = 0.9) -> DataFrame:
    """pixel_id, t, total: rain summed over each window's range.

    Rows: pixel_id, obs_date, rain.  The median spacing of dates says how many
    are due; a total is null if fewer than min_coverage of them are there, or if
    any of them is null.  A negative value fails the query.
    """
    checked = rain.withColumn("rain", F.when(F.col("rain") < 0, F.raise_error(F.lit("negative rain")).cast("double")).otherwise(F.col("rain")))
    dates = rain.select("obs_date").distinct()
    gaps = dates.selectExpr("datediff(obs_date, lag(obs_date) over (order by obs_date)) as gap").where("gap > 0")
    spacing = gaps.agg(F.coalesce(F.floor(F.percentile("gap", F.lit(0.5))), F.lit(1)).alias("spacing"))
    ranges = rain_ranges(windows, accumulation)
    members = dates.join(F.broadcast(ranges), F.col("obs_date").between(F.col("lo"), F.col("hi"))).groupBy("t").agg(F.count(F.lit(1)).alias("members"))
    due = ranges.join(F.broadcast(spacing)).join(members, "t", "left").select(
        "t", "lo", "hi", F.coalesce("members", F.lit(0)).alias("members"), F.greatest((F.datediff("hi", "lo") + 1) / F.greatest("spacing", F.lit(1)), F.lit(1.0)).alias("due")
    )
    full = due.where(F.col("members") / F.col("due") >= min_coverage)
    sums = checked.join(F.broadcast(full), F.col("obs_date").between(F.col("lo"), F.col("hi"))).groupBy("pixel_id", "t").agg(
        F.when((F.count("rain") == F.count(F.lit(1))) & (F.count(F.lit(1)) == F.first("members")), F.sum("rain")).alias("total")
    )
    return rain.select("pixel_id").distinct().join(F.broadcast(windows.select("t"))).join(sums, ["pixel_id", "t"], "left")


def resolve_cutoff(n_time: int, index: int = -1, fraction: float = 0.65, min_history: int = 12, min_future: int = 12) -> int:
    """The first step of the later part; both parts must be long enough."""
    cut = index if index >= 0 else round(fraction * n_time)
    if cut < min_history or n_time - cut < min_future:
        raise ValueError(f"cutoff {cut} of {n_time} leaves a part too short")
    return cut


def holdout_split(series: DataFrame, n_time: int, **kwargs) -> DataFrame:
    """pixel_id, part, ndvi, rain: the steps before and from the cutoff on."""
    cut = resolve_cutoff(n_time, **kwargs)
    part = lambda name, a, n: F.struct(F.lit(name).alias("part"), F.slice("ndvi", a + 1, n).alias("ndvi"), F.slice("rain", a + 1, n).alias("rain"))
    return series.select("pixel_id", F.explode(F.array(part("history", 0, cut), part("future", cut, n_time - cut))).alias("p")).select("pixel_id", "p.*")
