"""Whole runs: tiers, studies with broken scenes, and tiles that are written, broken off, gone on with and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import focal, runs

H = W = 48


@pytest.fixture(scope="module")
def px(spark):
    rows = []
    for s in range(10):
        for r in range(H):
            for c in range(W):
                hill = 300 + s + 0.2 * r + 4 * np.sin(c / 8)
                tall = 10 <= r < 18 and 20 <= c < 30
                ref = float(hill + (9 if tall else 0))
                water = r >= 40 and c < 24
                d = None if s == 4 or (s == 6 and (r, c) == (20, 21)) else (ref - 280) / (50 + c / 10)
                rows.append((s, r, c, d, 2 if tall else 4 if water else 0, float(hill) if s != 7 else None, ref))
    return spark.createDataFrame(rows, "scene_id int, row int, col int, d double, sem int, dem double, ref double").cache()


@pytest.fixture(scope="module")
def scenes(spark):
    return spark.createDataFrame([(s, s != 8, "srtm.tif") for s in range(10)], "scene_id int, georeferenced boolean, dem_source string")


def test_anchors_follow_the_tier(spark, px, scenes):
    gcps = spark.createDataFrame([(s, k, 3 * k, 300.0) for s in (1, 2) for k in range(4 if s == 1 else 2)], "scene_id int, row int, col int, elev_m double")
    tiers = runs.scene_tiers(scenes, px, gcps)
    assert {r["scene_id"]: r["tier"] for r in tiers.collect()} == {s: "B" if s == 1 else "C" if s in (7, 8) else "A" for s in range(10)}
    dry = px.filter("scene_id in (1, 2, 7, 8)").withColumn("sem", F.when(F.col("scene_id") == 7, F.lit(0)).otherwise(F.col("sem")))
    shadows = spark.createDataFrame([(2, 5, 6, 9.0, 5, 9, 0.5)], "scene_id int, row int, col int, value_m double, ref_row int, ref_col int, weight double")
    found, counts = runs.tier_anchors(dry, tiers, W, 1.0, gcps, shadows, 8, least_water=50)
    got = {}
    for r in counts.collect():
        got.setdefault(r["scene_id"], {})[r["source"]] = r["n"]
    assert set(got[1]) == {"dem", "water", "gcp"} and got[1]["gcp"] == 4
    assert set(got[2]) == {"dem", "water", "shadow"}
    assert set(got[7]) == {"ground_plane"} and set(got[8]) == {"water"}
    level = found.filter("scene_id = 8").first()
    assert level["value_m"] == 0 and level["ref_row"] is not None
    assert found.select("anchor_id").distinct().count() == found.count()


def test_one_broken_scene_does_not_stop_the_others(spark, px, scenes):
    inventory = px.select("scene_id").distinct().select("scene_id", F.when(F.col("scene_id") != 9, F.lit("i")).alias("image"), F.lit("r").alias("reference"))
    cut = px.filter("not (scene_id = 5 and row = 0)")
    records, summary = runs.run_study(inventory, cut, scenes, H, W, 1.0, stride=16, replicates=3, smooth=6.0, anchor_stride=6, least_water=50)
    got = {r["scene_id"]: r for r in records.collect()}
    assert len(got) == 10
    assert {s: r["reason"] for s, r in got.items() if r["reason"]} == {4: "no relative depth", 5: "grid mismatch", 9: "no image"}
    for s in (0, 1, 2, 3, 6):
        # The hole of scene 6 is filled, so every pixel is scored.
        assert got[s]["tier"] == "A" and got[s]["n_px"] == H * W and got[s]["mae_m"] < 1.0, s
        assert got[s]["anchors"]["dem"] > 20 and got[s]["n_used"] > 20
    assert got[7]["tier"] == got[8]["tier"] == "C" and got[7]["mae_m"] is not None
    n = {r["metric"]: r["n"] for r in summary.collect()}
    assert n == {"mae_m": 7, "rmse_m": 7, "bias_m": 7}


def test_heights_stand_on_bare_earth(spark, px, scenes):
    pixels, report = runs.calibrate(px.filter("scene_id in (0, 8)"), scenes.filter("scene_id in (0, 8)"), H, W, 1.0, stride=16, replicates=3, smooth=6.0, anchor_stride=6, least_water=50)
    out = pixels.filter("scene_id = 0").toPandas()
    on = out[(out["row"].between(12, 15)) & (out["col"].between(22, 27))]
    off = out[(out["row"] > 25)]
    assert on["ndsm_m"].mean() > 5 and off["ndsm_m"].mean() < 1 and (out["ndsm_m"] >= 0).all()
    # Where the elevation model is used its accuracy is part of the deviation.
    assert out["sigma_m"].min() >= 6.0
    assert pixels.filter("scene_id = 8").agg(F.min("sigma_m")).first()[0] < 6.0
    assert {r["scene_id"]: r["tier"] for r in report.collect()} == {0: "A", 8: "C"}


def test_tiles_are_read_back_and_runs_go_on(spark, px, tmp_path):
    path = str(tmp_path / "tiles")
    own = px.filter("scene_id < 3").select("scene_id", "row", "col", "ref", F.col("sem").cast("double").alias("sem"))
    first = runs.build_tileset(own.filter("scene_id = 0"), ["ref", "sem"], path, H, W, 20, 1, 3)
    assert first.count() == 2
    # Half of scene 1: its coarser levels are lost.
    runs.build_tileset(own.filter("scene_id = 1"), ["ref"], path, H, W, 20, 1, 1)
    before = {(r["scene_id"], r["run"]) for r in spark.read.parquet(path).select("scene_id", "run").distinct().collect()}
    manifest = runs.build_tileset(own, ["ref", "sem"], path, H, W, 20, 1, 3).collect()
    after = {(r["scene_id"], r["run"]) for r in spark.read.parquet(path).select("scene_id", "run").distinct().collect()}
    assert {s for s, _ in after - before} == {1, 2}
    assert {(r["scene_id"], r["layer"]) for r in manifest} == {(s, x) for s in range(3) for x in ("ref", "sem")}
    for r in manifest:
        assert [(x["lod"], x["h"], x["w"], len(x["tiles"])) for x in r["lods"]] == [(0, 48, 48, 9), (1, 24, 24, 4), (2, 12, 12, 1)]
        assert r["bytes"] == sum(t["bytes"] for x in r["lods"] for t in x["tiles"])
    long = focal.pyramid(own, 3, H, W).unpivot(["scene_id", "lod", "row", "col"], ["ref", "sem"], "layer", "was")
    met = runs.decode_tiles(runs.read_tiles(spark, path)).join(long, ["scene_id", "layer", "lod", "row", "col"], "full").toPandas()
    assert len(met) == 3 * 2 * (48 * 48 + 24 * 24 + 12 * 12) and (met["v"] - met["was"]).abs().max() < 2e-6
    report = runs.delivery_report(own, ["ref"], runs.read_tiles(spark, path).filter("layer = 'ref'"), H, W, 2, (16, 8)).collect()
    assert {r["section"] for r in report} == {"payload", "quantisation", "roundtrip"}
    assert {r["value"] for r in report if r["measure"] == "within"} == {1.0}
