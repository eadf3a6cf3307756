"""Result tables of a study: maps, areas, quality, method and sensor comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_map(long: DataFrame, x: str = "ndvi") -> DataFrame:
    """pixel_id, mean, std (of the population), n_valid."""
    return long.groupBy("pixel_id").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n_valid"))


def trend_areas(features: DataFrame, cell_km2: float, alpha: float = 0.05) -> DataFrame:
    """class, n_pixels, area_km2, fraction, median_sen of rising, falling and other
    pixels."""
    significant = F.coalesce(F.col("mk_p_value") < alpha, F.lit(False))
    name = F.when(significant & (F.col("sen") > 0), "significant_increase").when(significant & (F.col("sen") < 0), "significant_decrease").when(~significant, "no_significant_trend")
    counted = features.withColumn("class", name).where("class is not null")
    whole = counted.agg(F.count(F.lit(1)).alias("whole"))
    out = counted.groupBy("class").agg(F.count(F.lit(1)).alias("n_pixels"), F.percentile("sen", F.lit(0.5)).alias("median_sen"))
    return out.join(F.broadcast(whole)).select("class", "n_pixels", (F.col("n_pixels") * cell_km2).alias("area_km2"), (F.col("n_pixels") / F.col("whole")).alias("fraction"), "median_sen")


def feature_quality(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, n_finite, missing_fraction, mean, std (of the sample), min, p25,
    median, p75, max of each column."""
    rows = features.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("r")).select("r.*")
    q = lambda p: F.percentile("v", F.lit(p))
    return rows.groupBy("feature").agg(
        F.count("v").alias("n_finite"), (1 - F.count("v") / F.count(F.lit(1))).alias("missing_fraction"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max("v").alias("max"),
    )


def status_areas(recovered: DataFrame, names: dict[int, str], cell_km2: float, status: str = "rec.status") -> DataFrame:
    """status, name, n_pixels, area_km2 of every recovery status, zeros included."""
    table = recovered.sparkSession.createDataFrame(list(names.items()), "status int, name string")
    counts = recovered.groupBy(F.col(status).cast("int").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return table.join(counts, "status", "left").select("status", "name", n.alias("n_pixels"), (n * cell_km2).alias("area_km2"))


def method_comparison(flags: DataFrame) -> DataFrame:
    """truth, method, n_pixels, pct_flagged."""
    return flags.groupBy("truth", "method").agg(F.count(F.lit(1)).alias("n_pixels"), (100 * F.avg(F.col("flagged").cast("int"))).alias("pct_flagged"))


def confounder_rates(flags: DataFrame, targets: list[int], classes: list[int]) -> DataFrame:
    """One row for each method, one column fpr_<class> for each class that is no
    target: the share of its pixels that are flagged."""
    rest = flags.where(~F.col("truth").isin(*targets)).withColumn("c", F.concat(F.lit("fpr_"), F.col("truth")))
    return rest.groupBy("method").pivot("c", [f"fpr_{c}" for c in classes if c not in targets]).agg(F.avg(F.col("flagged").cast("int")))


def paired_differences(pairs: DataFrame, cells: DataFrame, least: int = 500) -> DataFrame:
    """left_id, right_id, n_common, median_difference: left less right, pixel by
    pixel, of the scene pairs with at least ``least`` common pixels.

    ``cells`` holds scene_id, pixel_id, value.
    """
    a, b = (cells.where("value is not null").select(F.col("scene_id").alias(k), "pixel_id", F.col("value").alias(v)) for k, v in (("left_id", "a"), ("right_id", "b")))
    both = pairs.select("left_id", "right_id").join(a, "left_id").join(b, ["right_id", "pixel_id"])
    out = both.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n_common"), F.percentile(F.col("a") - F.col("b"), F.lit(0.5)).alias("median_difference"))
    return out.where(F.col("n_common") >= least)


def pooled_difference(differences: DataFrame) -> DataFrame:
    """n_pairs, pooled (weighted by common pixels), mean and sd of the pairs' medians."""
    m, w = F.col("median_difference"), F.col("n_common")
    return differences.agg(F.count(F.lit(1)).alias("n_pairs"), (F.sum(m * w) / F.sum(w)).alias("pooled_median"), F.avg(m).alias("mean_of_medians"), F.stddev_samp(m).alias("sd_of_medians"))


def sensor_year_counts(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("sensor", F.year("obs_date").alias("year")).agg(F.count(F.lit(1)).alias("n_scenes"))


def attach_labels(pixels: DataFrame, labels: DataFrame, nodata: int = -1) -> DataFrame:
    """``pixels`` with label by grid position; none where there is no label or the
    no-data mark."""
    known = labels.where(F.col("label") != nodata).select("row", "col", "label")
    return pixels.join(known, ["row", "col"], "left")


def crop(cells: DataFrame, bounds: tuple[float, float, float, float], west: float, north: float, step: float, height: int, width: int, pad: int = 0) -> DataFrame:
    """The cells of the window of rows and columns that covers ``bounds`` (west,
    south, east, north); no overlap raises."""
    import math

    at = lambda v: math.floor(round(v / step, 9))
    r0, r1 = max(at(north - bounds[3]) - pad, 0), min(at(north - bounds[1]) + 1 + pad, height)
    c0, c1 = max(at(bounds[0] - west) - pad, 0), min(at(bounds[2] - west) + 1 + pad, width)
    if r1 <= r0 or c1 <= c0:
        raise ValueError("the bounds do not overlap the grid")
    return cells.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))


def results_table(features: DataFrame, cell_km2: float, alpha: float = 0.05) -> DataFrame:
    """quantity, value: the study's headline numbers as one long table."""
    yes = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("double")
    declining, rising = f"mk_p_value < {alpha} and sen < 0", f"mk_p_value < {alpha} and sen > 0"
    one = {
        "pixels": F.count(F.lit(1)).cast("double"), "area_km2": F.count(F.lit(1)) * F.lit(cell_km2), "mean_ndvi": F.avg("mean"), "median_sen": F.percentile("sen", F.lit(0.5)),
        "declining_pixels": yes(declining), "rising_pixels": yes(rising), "declining_km2": yes(declining) * cell_km2, "rising_km2": yes(rising) * cell_km2,
        "restrend_valid_pixels": yes("restrend_valid = 1"), "restrend_declining_pixels": yes("restrend_significant = 1 and restrend < 0"), "mean_restrend_r2": F.avg("restrend_r2"),
        "periodic_pixels": yes("cyclicity_periodic = 1"), "mean_enrichment": F.avg("cyc_enrichment"), "break_pixels": yes("has_break = 1"), "significant_break_pixels": yes("breakpoint_significant = 1"),
        "disturbed_pixels": yes("has_disturbance = 1"), "recovered_pixels": yes("recovery_status = 1"), "recovering_pixels": yes("recovery_status = 2"), "mean_valid_steps": F.avg("n_valid_ndvi"),
        "mean_rain": F.avg("rain_mean"), "mean_correlation": F.avg("rain_ndvi_correlation"),
    }
    got = features.agg(*[v.alias(k) for k, v in one.items()])
    return got.select(F.explode(F.array(*[F.struct(F.lit(k).alias("quantity"), F.col(k).alias("value")) for k in one])).alias("r")).select("r.*")
