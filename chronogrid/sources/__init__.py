"""Manifests and boundaries in, tables and point features out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE_SCHEMA = "scene_id string, date string, sensor string, cloud_cover double, bands map<string,string>"


def scene_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of a JSON manifest, a list or an object with ``scenes``; unknown keys
    and an empty list raise.  The manifest describes files and is small."""
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    scenes = raw["scenes"] if isinstance(raw, dict) else raw
    known = {"scene_id", "date", "sensor", "cloud_cover", "bands"}
    for s in scenes:
        if set(s) - known:
            raise ValueError(f"unknown keys in scene: {sorted(set(s) - known)}")
    if not scenes:
        raise ValueError("the manifest lists no scenes")
    rows = [(s["scene_id"], s["date"], s["sensor"], None if s.get("cloud_cover") is None else float(s["cloud_cover"]), s.get("bands", {})) for s in scenes]
    return spark.createDataFrame(rows, SCENE_SCHEMA).withColumn("obs_date", F.to_date(F.substring("date", 1, 10))).drop("date")


def geojson_rings(text: str, **select: str) -> list[list[tuple[float, float]]]:
    """The rings of a geometry, feature or feature collection; of a collection the
    features whose properties equal ``select``.  Polygons are joined as they are."""
    data = json.loads(text)
    features = data["features"] if data["type"] == "FeatureCollection" else [data]
    rings = []
    for f in features:
        if f["type"] == "Feature":
            if any(f.get("properties", {}).get(k) != v for k, v in select.items()):
                continue
            f = f["geometry"]
        if f["type"] not in ("Polygon", "MultiPolygon"):
            raise ValueError(f"not a polygon: {f['type']}")
        for polygon in [f["coordinates"]] if f["type"] == "Polygon" else f["coordinates"]:
            rings += [[(float(x), float(y)) for x, y, *_ in ring] for ring in polygon]
    if not rings:
        raise ValueError("no polygon is left")
    return rings


def point_features(cells: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """One column ``feature``: a GeoJSON point for each cell centre, with all other
    columns as properties (null where missing)."""
    others = [c for c in cells.columns if c not in ("row", "col")]
    centre = F.array(F.lit(west) + (F.col("col") + 0.5) * step, F.lit(north) - (F.col("row") + 0.5) * step)
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), centre.alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties"))
    return cells.select(F.to_json(shape, {"ignoreNullFields": "false"}).alias("feature"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write Parquet, compressed CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    {"parquet": lambda: writer.parquet(path), "csv": lambda: writer.option("compression", "gzip").csv(path, header=True), "json": lambda: writer.json(path)}[kind]()
