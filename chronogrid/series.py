"""Adapters from tables to series.

A series table has one row for each pixel: pixel_id, row, col, and the arrays
ndvi and rain.  Position in an array is the time step; null is missing.  After
the one shuffle by pixel that makes it, every estimator is a projection.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels in a row of the grid that pixel_id is laid out on.
WIDTH = 10
#: Months from 1995-01 on, and days from 2024-01-01 on, of the two demo series.
MONTHS, DAYS = 83, 30


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero.

    Halves are those of the millionfold double, as in DuckDB; Spark's own round
    takes them from the shortest decimal that reads as the double.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 1e300, F.round(c * 1e6, 0) / F.lit(1e6)).otherwise(c) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All double columns but ``keep`` rounded to 6 places."""
    return df.select(*[r6(f"`{c}`").alias(c) if kind == "double" and c not in keep else F.col(f"`{c}`") for c, kind in df.dtypes])


def sealed(df: DataFrame) -> DataFrame:
    """The same rows, kept on executors (memory, then disk) and opaque to the
    optimizer.

    Estimators are chains of projections.  A filter, an explode or an aggregate
    on an estimate would be rewritten into all expressions below it, over and
    over, which takes the optimizer time exponential in the chain's length.  A
    lost part is computed again from its lineage.
    """
    return df.persist()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder that ``spark.checkpoint.dir``
    names; only in local mode, where it is unset, a folder of this process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def to_arrays(cells: DataFrame, n_time: int, values: Iterable[str] = ("ndvi", "rain")) -> DataFrame:
    """(pixel_id, t, values...) rows to one row of arrays for each pixel.

    Steps outside 0..n_time-1 are left out, steps without a row are null, and of
    rows that repeat a step the largest values count.
    """
    names = list(values)
    cell = F.struct(*names)
    grouped = (
        cells.where(F.col("t").between(0, n_time - 1))
        .groupBy("pixel_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", cell.alias("c"))))).alias("m"))
    )
    at = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n_time - 1)), lambda t: F.element_at("m", t)[n])
    return grouped.select("pixel_id", *[at(n).alias(n) for n in names])


def with_grid(series: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds row and col of the pixel."""
    return series.withColumns({"row": F.expr(f"cast(pixel_id div {width} as int)"), "col": F.expr(f"cast(pixel_id % {width} as int)")})


def to_long(series: DataFrame) -> DataFrame:
    """One row for each pixel and step of a series' ndvi and rain."""
    series = sealed(series.select("pixel_id", F.arrays_zip("ndvi", "rain").alias("c")))
    return series.select("pixel_id", F.posexplode("c").alias("t", "c")).select("pixel_id", "t", "c.ndvi", "c.rain")


def supplier_months(spark: SparkSession, folder: str) -> DataFrame:
    """Dense: suppliers as pixels, months as steps; discount and quantity."""
    lines = table(spark, folder, "lineitem")
    t = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    cells = lines.groupBy(F.col("l_suppkey").alias("pixel_id"), t.alias("t")).agg(
        F.round(F.avg("l_discount") * 10, 9).alias("ndvi"), F.round(F.sum("l_quantity"), 6).alias("rain")
    )
    return with_grid(to_arrays(cells, MONTHS))


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    """With gaps: users as pixels, days as steps; mean value and event count."""
    events = table(spark, folder, "events")
    t = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    cells = events.groupBy(F.col("user_id").alias("pixel_id"), t.alias("t")).agg(
        F.round(F.avg("value") / 487.3, 12).alias("ndvi"), F.count(F.lit(1)).cast("double").alias("rain")
    )
    return with_grid(to_arrays(cells, DAYS))
