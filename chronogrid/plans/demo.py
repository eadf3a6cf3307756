"""Demo inputs: the driver's tables in the roles of scenes, pixels and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import series as S
from .features import feature_table

#: Cells in a row of the demo grid, and its cell size in degrees below its top.
WIDTH, TOP, STEP = 10, 26.0, 0.1


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scenes: one observation each, of a customer's cell."""
    sensors = F.array(*[F.lit(s) for s in ("LANDSAT5_TM", "LANDSAT7_ETM", "LANDSAT8_OLI", "LANDSAT9_OLI2", "SENTINEL2_MSI")])
    return S.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scene_id"), F.expr("o_custkey % 50").alias("pixel_id"), F.to_date("o_orderdate").alias("obs_date"),
        F.element_at(sensors, F.substring("o_orderpriority", 1, 1).cast("int")).alias("sensor"), F.expr("if(o_orderkey % 23 = 0, null, cast((o_orderkey * 7) % 101 as double))").alias("cloud_cover"),
        F.expr("cast((o_orderkey * 37) % 20000 as int)").alias("red"), F.expr("cast((o_custkey * 101 + o_orderkey * 3) % 30000 as int)").alias("nir"),
        F.expr("cast((o_orderkey * 17) % 12000 as int)").alias("blue"), F.expr("cast((o_orderkey * 29) % 25000 as int)").alias("swir1"), F.expr("cast((o_orderkey * 41) % 25000 as int)").alias("swir2"),
        F.expr("cast((o_orderkey * 13) % 1024 as int)").alias("qa"), F.expr("if(o_orderkey % 17 = 0, 1, 0)").alias("radsat"), F.expr("cast(o_orderkey % 12 as int)").alias("scl"),
    )


SCENES_SQL = """sc AS (
  SELECT o_orderkey AS scene_id, o_custkey % 50 AS pixel_id, o_orderdate::DATE AS obs_date,
    ['LANDSAT5_TM','LANDSAT7_ETM','LANDSAT8_OLI','LANDSAT9_OLI2','SENTINEL2_MSI'][substr(o_orderpriority, 1, 1)::INTEGER] AS sensor,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE ((o_orderkey * 7) % 101)::DOUBLE END AS cloud_cover,
    (o_orderkey * 37) % 20000 AS red, (o_custkey * 101 + o_orderkey * 3) % 30000 AS nir, (o_orderkey * 17) % 12000 AS blue,
    (o_orderkey * 29) % 25000 AS swir1, (o_orderkey * 41) % 25000 AS swir2,
    (o_orderkey * 13) % 1024 AS qa, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS radsat, o_orderkey % 12 AS scl
  FROM orders
), sensors(sensor, scale, off, gain, bias) AS (VALUES ('LANDSAT5_TM', 2.75e-05::DOUBLE, -0.2::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('LANDSAT7_ETM', 2.75e-05, -0.2, 1.0, 0.0),
  ('LANDSAT8_OLI', 2.75e-05, -0.2, 0.9589, 0.0029), ('LANDSAT9_OLI2', 2.75e-05, -0.2, 0.9589, 0.0029), ('SENTINEL2_MSI', 1e-4, 0.0, NULL, NULL)
), refl AS (
  SELECT scene_id, pixel_id, obs_date, sensor, qa, radsat, gain, bias, cloud_cover, {bands}
  FROM sc JOIN sensors USING (sensor)
)""".replace("{bands}", ", ".join(f"CASE WHEN {b} <> 0 AND {b} * scale + off BETWEEN -0.2 AND 1.6 THEN {b} * scale + off END AS {b}" for b in ("red", "nir", "blue", "swir1", "swir2")))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Landsat-like scenes with their masked, harmonised index as value."""
    from ..operators.ingest import scene_index

    return scene_index(scenes(spark, d).where("sensor <> 'SENTINEL2_MSI'")).select("pixel_id", "scene_id", "obs_date", "sensor", F.round("value", 9).alias("value"))


OBSERVATIONS_SQL = SCENES_SQL + """, ob AS (
  SELECT pixel_id, scene_id, obs_date, sensor, round(gain * CASE WHEN (qa & 63) = 0 AND radsat = 0 AND abs(nir + red) >= 1e-10 AND (nir - red) / (nir + red) BETWEEN -1 AND 1
    THEN (nir - red) / (nir + red) END + bias, 9) AS value FROM refl WHERE sensor <> 'SENTINEL2_MSI'
)"""


def supplier_features(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(S.supplier_months(spark, d), S.MONTHS)


def user_features(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(S.user_days(spark, d), S.DAYS)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as evaluated pixels: truth, prediction and fold."""
    docs, labels = S.table(spark, d, "documents"), S.table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("pixel_id"), F.expr("cast(quality + 2 * toxic as int)").alias("truth"), F.expr("cast(if(doc_id % 7 = 0, doc_id % 3, quality + 2 * toxic) as int)").alias("prediction"), F.expr("cast(doc_id % 5 as int)").alias("fold")
    )


PREDICTIONS_SQL = """pr AS (
  SELECT d.doc_id AS pixel_id, quality + 2 * toxic AS truth, CASE WHEN d.doc_id % 7 = 0 THEN (d.doc_id % 3)::INTEGER ELSE quality + 2 * toxic END AS prediction, (d.doc_id % 5)::INTEGER AS fold
  FROM documents d JOIN labels USING (doc_id)
)"""


def method_flags(spark: SparkSession, d: str) -> DataFrame:
    """method, pixel_id, truth, flagged of three made-up methods."""
    base = predictions(spark, d)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.expr(c).alias("flagged"), F.expr(e).alias("evaluated")) for m, c, e in (
        ("a", "prediction = 2", "pixel_id % 11 <> 0"), ("b", "truth >= 2 or pixel_id % 9 = 0", "pixel_id % 13 <> 0"), ("c", "pixel_id % 4 = 0", "true"))]))
    return base.withColumn("r", rows).select("r.method", "pixel_id", "truth", "r.flagged", "r.evaluated")


METHODS_SQL = PREDICTIONS_SQL + """, mf AS (
  SELECT 'a' AS method, pixel_id, truth, prediction = 2 AS flagged, pixel_id % 11 <> 0 AS evaluated FROM pr
  UNION ALL SELECT 'b', pixel_id, truth, truth >= 2 OR pixel_id % 9 = 0, pixel_id % 13 <> 0 FROM pr
  UNION ALL SELECT 'c', pixel_id, truth, pixel_id % 4 = 0, true FROM pr
)"""


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cells of a grid 40 wide: pixel_id, row, col, value (with gaps)."""
    return S.table(spark, d, "part").select(F.expr("p_partkey - 1").alias("pixel_id")).select("pixel_id", F.expr("cast(pixel_id div 40 as int)").alias("row"), F.expr("cast(pixel_id % 40 as int)").alias("col"), F.expr("if(pixel_id % 9 = 4, null, cast((pixel_id * 7919) % 1000 as double))").alias("value"))


CELLS_SQL = """ce AS (
  SELECT p_partkey - 1 AS pixel_id, ((p_partkey - 1) // 40)::INTEGER AS row, ((p_partkey - 1) % 40)::INTEGER AS col,
    CASE WHEN (p_partkey - 1) % 9 = 4 THEN NULL ELSE (((p_partkey - 1) * 7919) % 1000)::DOUBLE END AS value FROM part
)"""
