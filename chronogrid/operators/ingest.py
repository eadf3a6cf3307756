"""From stored scene values to usable index values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Quality bits of Landsat Collection 2 QA_PIXEL.
QA_BITS = {"fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "cloud_shadow": 4, "snow": 5, "clear": 6, "water": 7}
DEFAULT_MASK_BITS = ("fill", "dilated_cloud", "cirrus", "cloud", "cloud_shadow", "snow")
# Sentinel-2 scene classes that cannot be used.
SCL_EXCLUDE = (0, 1, 3, 8, 9, 10, 11)
# Sensor, scale, offset, and gain and bias onto the reference
# sensor's index (none: the sensor cannot be mixed with others).
SENSORS = (
    ("LANDSAT5_TM", 2.75e-05, -0.2, 1.0, 0.0),
    ("LANDSAT7_ETM", 2.75e-05, -0.2, 1.0, 0.0),
    ("LANDSAT8_OLI", 2.75e-05, -0.2, 0.9589, 0.0029),
    ("LANDSAT9_OLI2", 2.75e-05, -0.2, 0.9589, 0.0029),
    ("SENTINEL2_MSI", 1e-4, 0.0, None, None),
)
BANDS = ("blue", "red", "nir", "swir1", "swir2")
#: Numerator, denominator of each index over reflectance columns.
INDICES = {
    "ndvi": ("nir - red", "nir + red"),
    "evi": ("2.5D * (nir - red)", "nir + 6D * red - 7.5D * blue + 1D"),
    "nbr": ("nir - swir2", "nir + swir2"),
    "ndmi": ("nir - swir1", "nir + swir1"),
}


def sensor_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENSORS, "sensor string, scale double, offset double, gain double, bias double")


def scale_factors(v: Column, scale: Column, offset: Column, low: float = -0.2, high: float = 1.6) -> Column:
    """Stored integers to reflectance: fill (0) and impossible results are null."""
    out = F.when(v != 0, v * scale + offset)
    return F.when(out.between(low, high), out)


def qa_usable(qa: Column, radsat: Column | None = None, exclude: tuple = DEFAULT_MASK_BITS, most_confidence: int | None = None) -> Column:
    """Whether none of the named bits is set, nothing is saturated, and the cloud
    confidence field is at most ``most_confidence`` (if given)."""
    unknown = [b for b in exclude if b not in QA_BITS]
    if unknown:
        raise ValueError(f"unknown quality bits {unknown}")
    good = qa.bitwiseAND(sum(1 << QA_BITS[b] for b in exclude)) == 0
    if most_confidence is not None:
        good = good & (F.shiftright(qa, 8).bitwiseAND(3) <= most_confidence)
    return good if radsat is None else good & (F.coalesce(radsat, F.lit(0)) == 0)


def scl_usable(scl: Column, exclude: tuple = SCL_EXCLUDE) -> Column:
    return ~scl.isin(*exclude)


def spectral_index(name: str) -> Column:
    """An index over reflectance columns nir, red, ...: null where the denominator
    vanishes or the result is out of [-1, 1]."""
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; there are {sorted(INDICES)}")
    num, den = INDICES[name]
    value = F.when(F.abs(F.expr(den)) >= 1e-10, F.expr(f"({num}) / ({den})"))
    return F.when(value.between(-1.0, 1.0), value)


def harmonise(scenes: DataFrame, index: str = "ndvi") -> DataFrame:
    """The index on the reference sensor's scale.  A sensor without coefficients
    fails the query: identity is never assumed."""
    known = sensor_table(scenes.sparkSession).select("sensor", "gain", "bias")
    value = F.when(F.col("gain").isNull() & F.col(index).isNotNull(), F.raise_error(F.concat(F.lit("no harmonisation for sensor "), F.coalesce("sensor", F.lit("null")))).cast("double")).otherwise(F.col("gain") * F.col(index) + F.col("bias"))
    return scenes.join(F.broadcast(known), "sensor", "left").withColumn(index, value).drop("gain", "bias")


def cloud_prefilter(scenes: DataFrame, most: float = 80.0) -> DataFrame:
    """Adds skipped: a known cloud cover above the limit."""
    return scenes.withColumn("skipped", F.coalesce(F.col("cloud_cover") > most, F.lit(False)))


def scene_index(observations: DataFrame, index: str = "ndvi") -> DataFrame:
    """Scale, mask, index and harmonise observations of scenes: adds value, null
    where the observation cannot be used.

    Columns: sensor, qa, radsat, and the bands that the index names, all of which
    are scaled.  An unknown sensor and a missing quality word fail the query.
    """
    if index not in INDICES:
        raise ValueError(f"unknown index {index!r}; there are {sorted(INDICES)}")
    used = [b for b in BANDS if re.search(rf"\b{b}\b", " ".join(INDICES[index]))]
    missing = [c for c in ("sensor", "qa", *used) if c not in observations.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    known = sensor_table(observations.sparkSession).select("sensor", "scale", "offset")
    joined = observations.join(F.broadcast(known), "sensor", "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.col("sensor"), F.lit("null"))))
    scale = F.when(F.col("scale").isNull(), fail("no scale factors for sensor ").cast("double")).otherwise(F.col("scale"))
    qa = F.when(F.col("qa").isNull(), fail("a missing quality word from sensor ").cast("int")).otherwise(F.col("qa"))
    radsat = F.col("radsat") if "radsat" in observations.columns else None
    scaled = joined.withColumns({b: scale_factors(F.col(b), scale, F.col("offset")) for b in used})
    valued = scaled.withColumn("value", F.when(qa_usable(qa, radsat), spectral_index(index)))
    return harmonise(valued, "value").drop("scale", "offset")


def block_aggregate(cells: DataFrame, factor: int, height: int, width: int, value: str = "value") -> DataFrame:
    """Means, medians, counts and spread of whole blocks of factor x factor cells;
    ragged edges are dropped, and blocks without a value stay with nulls."""
    inside = cells.where((F.col("row") < height // factor * factor) & (F.col("col") < width // factor * factor))
    return inside.groupBy(F.expr(f"cast(row div {factor} as int)").alias("block_row"), F.expr(f"cast(col div {factor} as int)").alias("block_col")).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n_valid"), F.stddev_pop(value).alias("std")
    )


def clean_rain(values: DataFrame, value: str = "rain", nodata: float = -9998.0) -> DataFrame:
    """Values at or below the no-data mark become null."""
    return values.withColumn(value, F.when(F.col(value) > nodata, F.col(value)))


def describe_indices(spark: SparkSession) -> DataFrame:
    """index, numerator, denominator, bands of every spectral index."""
    rows = [(n, a, b, [x for x in BANDS if re.search(rf"\b{x}\b", a + " " + b)]) for n, (a, b) in INDICES.items()]
    return spark.createDataFrame(rows, "index string, numerator string, denominator string, bands array<string>")
