import json
from datetime import datetime

import pytest

from chronogrid.sources import geojson_rings, point_features, scene_manifest
from chronogrid.streaming import streaming_composites


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"scenes": [{"scene_id": "a", "date": "2001-02-03T00:00", "sensor": "LANDSAT5_TM"}]}))
    row = scene_manifest(spark, str(p)).first()
    assert row.scene_id == "a" and str(row.obs_date) == "2001-02-03" and row.cloud_cover is None
    p.write_text("[]")
    with pytest.raises(ValueError):
        scene_manifest(spark, str(p))


def test_geojson():
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    f = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    assert len(geojson_rings(json.dumps({"type": "FeatureCollection", "features": [f, f]}), name="x")) == 2
    with pytest.raises(ValueError):
        geojson_rings(json.dumps({"type": "FeatureCollection", "features": [f]}), name="y")
    with pytest.raises(ValueError):
        geojson_rings('{"type": "Point", "coordinates": [0, 0]}')


def test_points(spark):
    row = point_features(spark.createDataFrame([(0, 1, None)], "row int, col int, v double"), 10.0, 20.0, 1.0).first()
    assert json.loads(row.feature) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [11.5, 19.5]}, "properties": {"v": None}}


def test_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1 + k), None if k == 2 else float(k)) for k in range(5)]
    spark.createDataFrame(rows, "pixel_id long, obs_ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pixel_id long, obs_ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = streaming_composites(stream).writeStream.format("memory").queryName("composites").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("composites").collect()
    assert sum(r.n_valid for r in got) == 4 and sum(r.n_masked for r in got) == 1
