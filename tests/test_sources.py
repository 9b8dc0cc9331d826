"""Inventories, survey points, map payloads and layers from small files."""

import json

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geo, tags
from rasterloom.sources import scenes


def test_inventory_pairs_companions(spark, tmp_path):
    for name in ("a.tif", "a_dsm.tif", "a_dem.tif", "b.tif", "c_dsm.tif", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = {r["name"]: r for r in scenes.scene_inventory(scenes.list_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["reference"].endswith("a_dsm.tif") and rows["a"]["dtm"] is None and rows["b"]["dem"] is None
    with pytest.raises(KeyError):
        scenes.scene_inventory(scenes.list_files(spark, str(tmp_path)), "other")
    with pytest.raises(FileNotFoundError, match="_AGL.tif"):
        scenes.require_scenes(scenes.scene_inventory(scenes.list_files(spark, str(tmp_path)), "us3d"), "us3d")


def test_survey_points(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Row,COL,Z,Label\n1,2.0,3.5,p\n4,5,6,\n")
    rows = [tuple(r) for r in scenes.read_gcps(spark, str(tmp_path / "g.csv")).orderBy("row").collect()]
    assert rows == [(1, 2, 3.5, "p"), (4, 5, 6.0, "")]
    (tmp_path / "w.csv").write_text("x,y,elev_m\n1,2,3\n")
    with pytest.raises(ValueError, match="row, col"):
        scenes.read_gcps(spark, str(tmp_path / "w.csv"))


def test_map_payload(spark):
    point = lambda k: {"lat": float(k), "lon": 1.0}
    ring = [point(k) for k in range(5)]
    payload = {
        "elements": [
            {"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": ring},
            {"type": "way", "id": 2, "tags": {"building": "yes"}, "geometry": ring[:3]},
            {"type": "way", "id": 3, "tags": {"highway": "service", "width": "4,5 m"}, "geometry": ring[:2]},
            {"type": "relation", "id": 4, "tags": {"building": "yes"}, "members": [{"role": "outer", "geometry": ring}, {"role": "inner", "geometry": ring}]},
            {"type": "node", "id": 5},
        ]
    }
    df = scenes.read_osm(spark.createDataFrame([(0, json.dumps(payload))], "scene_id int, json string"))
    assert sorted((r["feature_id"], r["kind"], len(r["pts"])) for r in df.collect()) == [(1, "building", 5), (3, "road", 2), (4, "building", 5)]
    assert df.filter("kind = 'road'").select(tags.road_width(F.col("tags"))).first()[0] == 4.5


def test_layers_round_trip_and_json(spark, tmp_path):
    px = spark.createDataFrame([(0, 0, 0, 1.5, -9999.0), (0, 0, 1, float("nan"), 2.0)], "scene_id int, row int, col int, dsm double, dtm double")
    px.write.parquet(str(tmp_path / "px"))
    got = scenes.read_px(spark, str(tmp_path / "px"), ["dtm", "absent"])
    assert got.columns == ["scene_id", "row", "col", "dtm"] and got.filter("dtm is null").count() == 1
    scenes.write_layers(got, str(tmp_path / "layers"), ["dtm"])
    assert spark.read.parquet(str(tmp_path / "layers")).filter("layer = 'dtm'").count() == 1
    assert json.loads(scenes.strict_json(px.filter("col = 1")).first()[0])["dsm"] is None


def test_scale_model_of_a_backbone(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"backbone": "vitl", "kind": "constant", "value": 2.0, "unknown": 1}))
    assert scenes.load_scale_model(spark, str(tmp_path / "m.json"), "vitl").first()["value"] == 2.0
    assert scenes.load_scale_model(spark, str(tmp_path / "m.json"), "vits").count() == 0


def test_solar_position_at_known_times(spark):
    rows = [("2024-06-20 12:00:00", 23.44, 0.0, 90.0), ("2024-03-20 12:07:00", 0.0, 0.0, 89.7), ("2024-12-21 12:00:00", 51.48, 0.0, 15.1)]
    df = spark.createDataFrame(rows, "t string, lat double, lon double, elevation double")
    got = df.select("elevation", geo.solar_position(F.col("lat"), F.col("lon"), F.to_timestamp("t"))[1].alias("e")).collect()
    assert all(abs(r["e"] - r["elevation"]) < 0.6 for r in got)


def test_degenerate_affine_is_an_error(spark):
    df = spark.createDataFrame([([0.0] * 6,)], "t array<double>")
    with pytest.raises(Exception, match="degenerate"):
        df.select(geo.world_to_pixel(F.col("t"), F.lit(1.0), F.lit(1.0))[0]).collect()
