"""Joins by nearness, rank and key that the pipeline needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, on_left: str, on_right: str, tolerance: int, by: str | None = None) -> DataFrame:
    """The nearest row of ``right`` in days for each row of ``left``, within the
    tolerance; of equally near ones the earlier, then the smaller id.

    left: id, date in ``on_left``; right: id, date in ``on_right``.  Only the
    distinct days of both sides are compared, each with its first row,
    so that the work of a group is bounded by its days, not by its rows.  Days
    are put into buckets as long as the tolerance, so that the join is by
    equality on the bucket and its neighbours, and never compares all pairs.
    """
    keys = [by] if by else []
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / max(tolerance, 1))
    a = left.select(F.col("id").alias("left_id"), F.to_date(on_left).alias("a"), *keys)
    days = a.select("a", *keys).distinct().withColumn("bucket", F.explode(F.sequence(bucket("a") - 1, bucket("a") + 1)))
    b = right.select(F.to_date(on_right).alias("b"), F.struct(F.col(on_right).alias("at"), F.col("id").alias("right_id")).alias("r"), *keys).groupBy("b", *keys).agg(F.min("r").alias("r")).withColumn("bucket", bucket("b"))
    near = days.join(b, ["bucket", *keys]).withColumn("gap", F.abs(F.datediff("b", "a"))).where(F.col("gap") <= tolerance)
    best = near.groupBy("a", *keys).agg(F.min(F.struct("gap", "b", "r.right_id")).alias("m"))
    return a.join(best, ["a", *keys]).groupBy("left_id").agg(F.min("m").alias("m")).select("left_id", F.col("m.right_id").alias("right_id"), F.col("m.gap").alias("gap_days"))


def top_scenes(scenes: DataFrame, per_year: int) -> DataFrame:
    """The least cloudy scenes of each year; unknown cover counts as 999, ties go
    to the smaller id."""
    order = Window.partitionBy("year").orderBy(F.coalesce("cloud_cover", F.lit(999.0)), "scene_id")
    return scenes.withColumn("year", F.year("obs_date")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_year).select("year", "rank", "scene_id", "cloud_cover")


def rank_average(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Descending ranks in which equal values share their mean rank."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    above = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(above, value).withColumn(out, F.col("_before") + (F.col("_c") + 1) / 2).drop("_c", "_before")


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """quantity, before, after, change: a full outer join of two result tables."""
    a, b = before.select("quantity", F.col("value").alias("before")), after.select("quantity", F.col("value").alias("after"))
    return a.join(b, "quantity", "full").select("quantity", "before", "after", (F.col("after") - F.col("before")).alias("change"))


def common_set(predictions: DataFrame) -> DataFrame:
    """The predictions for pixels that every method evaluated."""
    methods = predictions.select("method").distinct().agg(F.count(F.lit(1)).alias("m"))
    full = predictions.where("evaluated").groupBy("pixel_id").agg(F.count_distinct("method").alias("n")).join(F.broadcast(methods)).where("n = m").select("pixel_id")
    return predictions.join(full, "pixel_id", "left_semi")


def representative(features: DataFrame, label: str = "trajectory", min_valid: int = 25) -> DataFrame:
    """The most typical pixel of each class: least total deviation from the class
    medians in units of the class spread, among pixels with enough observations
    (among all, if a class has none); ties to the smaller pixel_id."""
    defining = ["sen", "mk_p_value", "restrend", "cyc_enrichment", "disturbance_magnitude", "recovery_fraction"]
    enough = F.max(F.col("n_valid_ndvi") >= min_valid).over(Window.partitionBy(label))
    pool = features.withColumn("_some", enough).where((F.col("n_valid_ndvi") >= min_valid) | ~F.col("_some"))
    stats = pool.groupBy(label).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in defining], *[F.stddev_pop(c).alias(f"_s_{c}") for c in defining], F.count(F.lit(1)).alias("n_candidates"))
    term = lambda c: f"coalesce(abs({c} - _m_{c}) / if(_s_{c} > 0, _s_{c}, 1D), 0D)"
    scored = pool.join(stats, label).withColumn("_d", F.round(F.expr(" + ".join(map(term, defining))), 9))
    best = scored.groupBy(label).agg(F.min(F.struct("_d", "pixel_id")).alias("m"), F.first("n_candidates").alias("n_candidates"))
    return best.select(label, F.col("m.pixel_id").alias("pixel_id"), F.col("m._d").alias("distance"), "n_candidates")


def sensor_years(scenes: DataFrame) -> DataFrame:
    """year, sensors (their names in order), n_scenes."""
    return scenes.groupBy(F.year("obs_date").alias("year")).agg(F.concat_ws("+", F.sort_array(F.collect_set("sensor"))).alias("sensors"), F.count(F.lit(1)).alias("n_scenes"))
