"""Whole runs over tables of scenes: anchors by tier, calibration with uncertainty, studies whose broken scenes become rows, and delivered tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import encode, geo
from rasterloom.operators import anchors as harvest
from rasterloom.operators import calibration, focal, joins, scores, tiling
from rasterloom.session import written

PIXEL = ("scene_id", "row", "col")
#: The steepest slope (degrees) at which an elevation model is believed, and weights of sources.
STEEP_DEG, DEM_WEIGHT, WATER_WEIGHT = 25.0, 0.6, 0.9


def scene_tiers(scenes: DataFrame, px: DataFrame, gcps: DataFrame | None = None, dem: str = "dem") -> DataFrame:
    """``scenes`` (scene_id, georeferenced, dem_source) with n_gcps, has_dem and tier: B with three survey points or more, A with a place and an elevation model, else C."""
    heights = px.groupBy("scene_id").agg((F.count(dem) > 0).alias("has_dem"))
    out = scenes.join(heights, "scene_id", "left").na.fill(False, ["has_dem"])
    if gcps is None:
        out = out.withColumn("n_gcps", F.lit(0).cast("long"))
    else:
        out = out.join(gcps.groupBy("scene_id").agg(F.count("*").alias("n_gcps")), "scene_id", "left").na.fill(0, ["n_gcps"])
    return out.withColumn("tier", geo.select_tier(F.col("n_gcps"), F.coalesce("georeferenced", F.lit(False)), F.col("has_dem")))


def tier_anchors(
    px: DataFrame, tiers: DataFrame, w: int, gsd: float, gcps: DataFrame | None = None, shadows: DataFrame | None = None, stride: int = 24, admissible: tuple[int, ...] = (0, 1, 4), least_water: int = 200
) -> tuple[DataFrame, DataFrame]:
    """(anchors, counts): what each scene's tier allows, and how many anchors of each source it has.

    Tiers A and B with an elevation model take its gentle admissible ground and its level on bodies
    of water; others only that water is level. Tier B adds survey points, every tier shadows
    (scene_id, row, col, value_m, ref_row, ref_col, weight). The ground plane is assumed only where
    a scene has no anchor at all. Scenes of all tiers go through one plan.
    """
    told = px.join(tiers.select("scene_id", "tier", "has_dem"), "scene_id")
    trusted = written(told.filter(F.col("tier").isin("A", "B") & F.col("has_dem")).select(*PIXEL, "sem", "d", "dem"), "trusted")
    dem = joins.harvest_dem(focal.slope_deg(trusted, "dem", gsd), "dem", admissible, stride, F.coalesce(F.col("slope") > STEEP_DEG, F.lit(False)), DEM_WEIGHT)
    water = harvest.harvest_water(trusted, w, "dem", stride=stride, weight=WATER_WEIGHT, least=least_water)
    level = harvest.harvest_water(told.join(trusted.select("scene_id").distinct(), "scene_id", "left_anti"), w, None, stride=stride, weight=WATER_WEIGHT, least=least_water)
    sources = [dem, water, level]
    if gcps is not None:
        sources.append(harvest.harvest_gcp(gcps.join(tiers.filter("tier = 'B'").select("scene_id"), "scene_id", "left_semi")))
    if shadows is not None:
        sources.append(shadows.select("scene_id", "row", "col", "value_m", "ref_row", "ref_col", F.lit("shadow").alias("source"), "weight"))
    some = written(harvest.build_anchors(*sources)[0], "anchors")
    bare = told.join(some.select("scene_id").distinct(), "scene_id", "left_anti")
    found = some.unionByName(harvest.ground_plane(bare, "d", admissible), allowMissingColumns=True)
    found = written(found.withColumn("anchor_id", F.monotonically_increasing_id()), "anchors")
    return found, found.groupBy("scene_id", "source").agg(F.count("*").alias("n"))


def calibrate(
    px: DataFrame, scenes: DataFrame, h: int, w: int, gsd: float, gcps: DataFrame | None = None, shadows: DataFrame | None = None, stride: int = 32, replicates: int = 24, smooth: float = 30.0, **settings
) -> tuple[DataFrame, DataFrame]:
    """(pixels, report): elevation of every scene from its relative depth.

    ``px``: scene_id, row, col, d (relative depth), sem (class) and dem (metres or null), every
    pixel of the raster. ``scenes``: scene_id, georeferenced, dem_source. Anchors by tier are solved
    on the lattice, bootstrap fits give the mean surface and its deviation, which the elevation
    model's own accuracy adds to where the tier uses it; holes are filled, bare earth is taken and
    heights stand above it. pixels: dsm_m, sigma_m, dtm_m, ndsm_m. report: tier, anchors of
    each source, used and rejected ones and the residual. A scene without usable anchors has no
    pixels and null counts.
    """
    tiers = written(scene_tiers(scenes, px, gcps), "tiers")
    found, counts = tier_anchors(px, tiers, w, gsd, gcps, shadows, settings.pop("anchor_stride", 24), least_water=settings.pop("least_water", 200))
    depth = px.select(*PIXEL, "d")
    near = depth.select("scene_id", F.col("row").alias("ref_row"), F.col("col").alias("ref_col"), F.col("d").alias("ref_d"))
    own = found.join(depth, list(PIXEL)).join(near, ["scene_id", "ref_row", "ref_col"], "left")
    own = own.filter(F.col("d").isNotNull() & (F.col("ref_row").isNull() | F.col("ref_d").isNotNull()))
    own = written(own.select("scene_id", "anchor_id", "row", "col", "d", "value_m", "weight", "ref_row", "ref_col", "ref_d"), "anchor-depths")
    _, fit = calibration.solve_agmc(own, h, w, stride, **settings)
    surface = calibration.bootstrap_sigma(px, own, h, w, stride, replicates, **settings)
    accuracy = F.when(F.col("has_dem") & F.col("tier").isin("A", "B"), geo.reference_sigma(geo.dem_source_name(F.col("dem_source")))).otherwise(0.0)
    spread = surface.join(tiers.select("scene_id", accuracy.alias("_ref")), "scene_id").withColumn("_sigma", encode.combine_sigma(F.col("sigma_m"), F.col("_ref")))
    whole = px.select(*PIXEL, "sem").join(surface.select("scene_id").distinct(), "scene_id", "left_semi").join(spread.select(*PIXEL, "mean_m", "_sigma"), list(PIXEL), "left")
    whole = written(whole, "surface")
    filled = joins.nearest_fill(joins.nearest_fill(whole, "mean_m", "dsm_m"), "_sigma", "filled_sigma")
    bare = harvest.extract_dtm(filled.select(*PIXEL, "sem", "dsm_m", F.col("filled_sigma").alias("sigma_m")), "dsm_m", h, w, gsd, smooth)
    pixels = bare.select(*PIXEL, "sem", "dsm_m", "sigma_m", F.col("dtm").alias("dtm_m"), F.greatest(F.col("dsm_m") - F.col("dtm"), F.lit(0.0)).alias("ndsm_m"))
    by_source = counts.groupBy("scene_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("anchors"))
    report = tiers.select("scene_id", "tier", "n_gcps", "has_dem").join(by_source, "scene_id", "left").join(fit, "scene_id", "left")
    return written(pixels, "elevation"), report


def broken_scenes(inventory: DataFrame, px: DataFrame, h: int, w: int) -> DataFrame:
    """scene_id and the first reason why a scene of ``inventory`` (scene_id, image, reference; paths or null) can't be run: one row for each such scene."""
    sizes = px.groupBy("scene_id").agg(F.count("*").alias("n"), F.count("d").alias("nd"), F.count("ref").alias("nr"), F.count_if(F.isnan("d")).alias("bad"), F.max("row").alias("r"), F.max("col").alias("c"))
    reason: Column = (
        F.when(F.col("image").isNull(), "no image").when(F.col("reference").isNull(), "no reference").when(F.col("n").isNull(), "no pixels")
        .when((F.col("r") >= h) | (F.col("c") >= w) | (F.col("n") != h * w), "grid mismatch").when(F.col("nd") == 0, "no relative depth")
        .when(F.col("bad") > 0, "depth isn't finite").when(F.col("nr") == 0, "empty reference")
    )
    return inventory.join(sizes, "scene_id", "left").select("scene_id", reason.alias("reason")).filter("reason is not null")


def run_study(
    inventory: DataFrame, px: DataFrame, scenes: DataFrame, h: int, w: int, gsd: float, metrics: tuple[str, ...] = ("mae_m", "rmse_m", "bias_m"), **settings
) -> tuple[DataFrame, DataFrame]:
    """(records, summary): every scene of ``inventory`` calibrated and scored, or told why not; and the metrics over scenes.

    ``px`` holds, besides what ``calibrate`` takes, ``ref``, the reference's metres. A broken scene
    (``broken_scenes``), or one without usable anchors, is a row with its ``reason`` and null
    scores; the others don't depend on it. All scenes run in one plan, not one by one.
    """
    bad = written(broken_scenes(inventory, px, h, w), "broken")
    good = inventory.join(bad, "scene_id", "left_anti").select("scene_id")
    fine = px.join(good, "scene_id", "left_semi")
    pixels, report = calibrate(fine, scenes.join(good, "scene_id", "left_semi"), h, w, gsd, **settings)
    scored = scores.evaluate(pixels.join(fine.select(*PIXEL, "ref"), list(PIXEL)), "dsm_m", "ref")
    own = inventory.join(bad, "scene_id", "left").join(report.select("scene_id", "tier", "anchors", "n_used", "rmse_m").withColumnRenamed("rmse_m", "anchor_rmse_m"), "scene_id", "left").join(scored, "scene_id", "left")
    reason = F.coalesce("reason", F.when(F.coalesce("n_px", F.lit(0)) == 0, "no usable anchors"))
    records = written(own.withColumn("reason", reason), "records")
    return records, scores.aggregate_study(records.filter("reason is null"), list(metrics))


def build_tileset(px: DataFrame, layers: list[str], path: str, h: int, w: int, tile: int = 512, pad: int = 1, levels: int = 3, bits: int = 24) -> DataFrame:
    """Writes every scene's layers as coded tiles of all levels of detail under ``path`` and returns the manifest, which is read from what was written.

    A layer has one range for a whole scene, so tiles and levels agree at their borders. A tile's
    payload is its pixels with ``pad`` around, in row order, three bytes each. Scenes whose tiles
    are all there already are left alone, so a run that broke off goes on where it stopped; those
    that are half there are written anew (rows: the last written run of a scene counts).
    Columns of the manifest: scene_id, layer, bits, lo, hi (for the plain decoder), bytes, lods
    (lod, h, w, and its tiles: tr, tc, y0, x0, h, w, bytes).
    """
    spark = px.sparkSession
    long = px.select(*PIXEL, *layers).unpivot(list(PIXEL), layers, "layer", "v")
    span = written(long.groupBy("scene_id", "layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo is not null"), "ranges")
    lods = [k for k in range(levels) if min(-(-h // 2**k), -(-w // 2**k)) >= 2]
    per_scene = sum(-(-(-(-h // 2**k)) // tile) * -(-(-(-w // 2**k)) // tile) for k in lods)
    done = read_tiles(spark, path)
    todo = span if done is None else span.join(done.groupBy("scene_id", "layer").count().filter(F.col("count") == per_scene), ["scene_id", "layer"], "left_anti").drop("count")
    if not todo.isEmpty():
        run = spark.sql("select uuid() as u").first()["u"]
        for k in lods:
            lh, lw = -(-h // 2**k), -(-w // 2**k)
            own = focal.pyramid(px.select(*PIXEL, *layers), levels, h, w).filter(F.col("lod") == k)
            each = own.unpivot(list(PIXEL), layers, "layer", "v").join(todo.select("scene_id", "layer"), ["scene_id", "layer"], "left_semi")
            # Layers are cut as scenes of their own, so that one plan cuts all of them.
            named = each.select(F.struct("scene_id", "layer").alias("scene_id"), "row", "col", "v")
            cut = tiling.cut_tiles(named, "v", lh, lw, tile, pad).withColumn("layer", F.col("scene_id.layer")).withColumn("scene_id", F.col("scene_id.scene_id")).join(todo, ["scene_id", "layer"])
            # Codes of a range of one value are all 0; other codes keep the top bits.
            rgb = lambda x: encode.encode_linear_bits(x, F.col("lo"), F.col("hi"), bits)
            code = F.transform("data", lambda x: F.lpad(F.hex(encode.unpack24(*rgb(x)).cast("long")), 6, "0"))
            low, high = encode.linear_range_for_bits(F.col("lo"), F.col("hi"), bits)
            rows = cut.select("scene_id", "layer", F.lit(run).alias("run"), "tr", "tc", "y0", "x0", "h", "w", low.alias("lo"), high.alias("hi"), F.unhex(F.array_join(code, "")).alias("payload"))
            rows.withColumn("lod", F.lit(k)).write.mode("append").partitionBy("lod").parquet(path)
    tiles = read_tiles(spark, path)
    entry = F.struct("tr", "tc", "y0", "x0", "h", "w", "bytes")
    levels_of = tiles.groupBy("scene_id", "layer", "lod").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(entry)).alias("tiles"), F.max(F.col("y0") + F.col("h")).alias("h"), F.max(F.col("x0") + F.col("w")).alias("w"))
    out = levels_of.groupBy("scene_id", "layer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("lod", "h", "w", "tiles"))).alias("lods"))
    return out.select("scene_id", "layer", F.lit(bits).alias("bits"), "lo", "hi", "bytes", "lods")


def read_tiles(spark: SparkSession, path: str) -> DataFrame | None:
    """The tiles of a tileset, each once (of runs that wrote it twice, the one of the greatest name), with ``bytes``; None where nothing is stored."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    keys = ["scene_id", "layer", "lod", "tr", "tc"]
    rest = [c for c in rows.columns if c not in (*keys, "run")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run").alias("t")).select(*keys, "t.*").withColumn("bytes", F.length("payload").cast("long"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def tile_codes(payload: pd.Series) -> pd.Series:
    """The 24-bit codes of a payload of three bytes each."""
    bytes_of = (np.frombuffer(p, np.uint8).reshape(-1, 3).astype(np.int64) for p in payload)
    return pd.Series([b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2] for b in bytes_of])


def decode_tiles(tiles: DataFrame, pad: int = 1) -> DataFrame:
    """scene_id, layer, lod, row, col, v: the pixels of ``read_tiles``, decoded by the recorded range, each once."""
    value = F.transform(tile_codes("payload"), lambda c: F.col("lo") + c / F.lit(float(encode.MAX_CODE)) * (F.col("hi") - F.col("lo")))
    named = tiles.select(F.struct("scene_id", "layer", "lod").alias("scene_id"), "y0", "x0", "h", "w", value.alias("data"))
    return tiling.reassemble(named, pad).select("scene_id.*", "row", "col", "v")


def delivery_report(px: DataFrame, layers: list[str], tiles: DataFrame, h: int, w: int, levels: int = 3, bits: tuple[int, ...] = (24, 16, 12, 8)) -> DataFrame:
    """section, scene_id, layer, lod, bits, measure, value: bytes by layer and level, errors and codes by bit depth, and errors of both codings by level, in one long table."""
    nil = lambda kind: F.lit(None).cast(kind)
    scene = px.schema["scene_id"].dataType.simpleString()

    def long(df: DataFrame, section: str, values: list[str], **keys: Column) -> DataFrame:
        named = {"scene_id": nil(scene), "layer": nil("string"), "lod": nil("int"), "bits": nil("int")} | keys
        return df.select(F.lit(section).alias("section"), *(c.alias(k) for k, c in named.items()), *(F.col(v).cast("double").alias(v) for v in values)).unpivot(["section", *named], values, "measure", "value")

    own = {"scene_id": F.col("scene_id"), "layer": F.col("layer")}
    payload = long(tiling.payload_report(tiles), "payload", ["bytes", "n_tiles"], layer=F.col("layer"), lod=F.col("lod").cast("int"))
    depth = long(tiling.quantisation_sweep(px, layers, bits), "quantisation", ["step", "worst", "n_codes", "cheapest"], **own, bits=F.col("bits"))
    trip = long(tiling.roundtrip_report(px, layers, levels, h, w), "roundtrip", ["terrain_error", "linear_error", "within"], **own, lod=F.col("lod"))
    return payload.unionByName(depth).unionByName(trip)
