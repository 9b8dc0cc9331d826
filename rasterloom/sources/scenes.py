"""Scene inventories, survey points, map payloads, elevation tiles and study records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File-name endings by layout.
SUFFIXES = {
    "generic": {"image": ".tif", "reference": "_dsm.tif", "dem": "_dem.tif", "dtm": "_dtm.tif", "semantics": "_sem.tif"},
    "us3d": {"image": "_RGB.tif", "reference": "_AGL.tif", "semantics": "_CLS.tif"},
}
#: What a layout's reference holds.
REFERENCE_KIND = {"generic": "dsm", "us3d": "ndsm"}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file under ``root``; the content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def scene_inventory(files: DataFrame, layout: str = "generic", suffixes: dict[str, str] | None = None) -> DataFrame:
    """name, image, reference, reference_kind and the other companions of every scene among ``path``.

    A file is of the kind whose ending is the longest that fits, so companions are never scenes.
    Files pair up by folder and stem; an absent companion is null, a companion without an image
    is no scene. An unknown layout is an error, and so, for the caller to see, is an empty result
    of ``require_scenes``.
    """
    if layout not in SUFFIXES:
        raise KeyError(f"unknown layout '{layout}'; known: {', '.join(SUFFIXES)}")
    ends = SUFFIXES[layout] | (suffixes or {})
    kind, cut = F.lit(None).cast("string"), F.lit(0)
    for k, end in sorted(ends.items(), key=lambda x: len(x[1])):
        kind, cut = F.when(F.col("path").endswith(end), k).otherwise(kind), F.when(F.col("path").endswith(end), len(end)).otherwise(cut)
    known = files.select("path", kind.alias("kind"), F.substring("path", F.lit(1), F.length("path") - cut).alias("stem")).filter("kind is not null")
    kinds = sorted(ends)
    wide = known.groupBy("stem").pivot("kind", kinds).agg(F.min("path")).filter("image is not null")
    return wide.select(F.regexp_extract("stem", r"[^/]*$", 0).alias("name"), *kinds, F.lit(REFERENCE_KIND[layout]).alias("reference_kind"))


def require_scenes(inventory: DataFrame, layout: str = "generic") -> DataFrame:
    """The inventory, or an error that names the endings it looked for."""
    if inventory.isEmpty():
        ends = SUFFIXES[layout]
        raise FileNotFoundError(f"no {layout} scenes: expected images ending {ends['image']} with siblings ending {ends['reference']}")
    return inventory


def read_gcps(spark: SparkSession, path: str) -> DataFrame:
    """row, col, elev_m, label from CSV; names in any case, the height as elev_m, elev or z; without row and col it is an error."""
    raw = spark.read.option("header", "true").csv(path)
    names = {c.lower().strip(): c for c in raw.columns}
    if not {"row", "col"} <= set(names):
        raise ValueError("survey points need row, col and elev_m columns; world x, y aren't converted")
    heights = [F.when(F.col(names[k]) != "", F.col(names[k])) for k in ("elev_m", "elev", "z") if k in names]
    label = F.coalesce(F.col(names["label"]), F.lit("")) if "label" in names else F.lit("")
    whole = lambda k: F.col(names[k]).cast("double").cast("int").alias(k)
    return raw.select(whole("row"), whole("col"), F.coalesce(*heights).cast("double").alias("elev_m"), label.alias("label"))


OSM_SCHEMA = (
    "elements array<struct<type: string, id: bigint, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>, "
    "members: array<struct<role: string, type: string, geometry: array<struct<lat: double, lon: double>>>>>>"
)


def read_osm(payload: DataFrame, text: str = "json") -> DataFrame:
    """scene_id, feature_id, kind (building or road), tags and ``pts`` (lat, lon) of map payloads.

    Building ways and the outer rings of building relations with four points or more, and highway
    ways with two or more; inner rings are left out.
    """
    rows = payload.select("scene_id", F.explode(F.from_json(text, OSM_SCHEMA)["elements"]).alias("e")).select("scene_id", "e.*")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    long = lambda g, n: F.coalesce(F.size(g), F.lit(0)) >= n
    ways = rows.filter("type = 'way'")
    buildings = ways.filter(tag("building").isNotNull() & long("geometry", 4)).select("scene_id", F.col("id").alias("feature_id"), F.lit("building").alias("kind"), "tags", F.col("geometry").alias("pts"))
    roads = ways.filter(tag("highway").isNotNull() & tag("building").isNull() & long("geometry", 2)).select("scene_id", F.col("id").alias("feature_id"), F.lit("road").alias("kind"), "tags", F.col("geometry").alias("pts"))
    rings = rows.filter((F.col("type") == "relation") & tag("building").isNotNull()).select("scene_id", "id", "tags", F.explode("members").alias("m"))
    rings = rings.filter((F.coalesce("m.role", F.lit("outer")) != "inner") & long("m.geometry", 4)).select("scene_id", F.col("id").alias("feature_id"), F.lit("building").alias("kind"), "tags", F.col("m.geometry").alias("pts"))
    return buildings.unionByName(roads).unionByName(rings)


def tile_name(lat: Column, lon: Column, resolution: int = 10) -> Column:
    """The name of the one-degree elevation tile whose south-west corner is (lat, lon)."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.format_string(f"Copernicus_DSM_COG_{resolution}_%s%02d_00_%s%03d_00_DEM", ns, F.abs(lat), ew, F.abs(lon))


def required_dem_tiles(bounds: DataFrame, resolution: int = 10) -> DataFrame:
    """scene_id, lat, lon, name of every one-degree tile that a box (w, s, e, n) touches."""
    span = lambda a, b: F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int"))
    rows = bounds.select("scene_id", F.explode(span("s", "n")).alias("lat"), span("w", "e").alias("_lon"))
    rows = rows.select("scene_id", "lat", F.explode("_lon").alias("lon"))
    return rows.withColumn("name", tile_name(F.col("lat"), F.col("lon"), resolution))


def mosaic_dem(samples: DataFrame, order: str = "tile", value: str = "v") -> DataFrame:
    """scene_id, row, col and the first value by tile order that is there, of equals the least; null, not 0, where no tile has one."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(order, value)))
    return samples.groupBy("scene_id", "row", "col").agg(first.alias(value))


def dem_coverage(mosaic: DataFrame, grid: DataFrame, value: str = "v") -> DataFrame:
    """scene_id, the share of the pixels of ``grid`` that ``mosaic_dem`` has a value for, and a reason where it has none."""
    share = grid.select("scene_id", "row", "col").join(mosaic, ["scene_id", "row", "col"], "left").groupBy("scene_id").agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))
    return share.withColumn("reason", F.when(F.col("coverage") == 0, "no elevation tile covers the scene"))


def require_coverage(coverage: DataFrame) -> DataFrame:
    """The coverage, or an error that names the first scene without any."""
    bare = coverage.filter("reason is not null").orderBy("scene_id").limit(1).collect()
    if bare:
        raise ValueError(f"scene {bare[0]['scene_id']}: {bare[0]['reason']}")
    return coverage


def strict_json(df: DataFrame) -> DataFrame:
    """``json``: each row as JSON, numbers that aren't finite as null."""
    cols = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def completed_scenes(inventory: DataFrame, summaries: DataFrame, want_delivery: bool = False) -> DataFrame:
    """The scenes that are still to do: without a summary that has metrics (and a delivery, where wanted)."""
    done = summaries.filter(F.col("metrics").isNotNull() & (F.col("delivery").isNotNull() | F.lit(not want_delivery)))
    return inventory.join(done.select("name"), "name", "left_anti")


def phase2_summary(direct: DataFrame, study: DataFrame) -> DataFrame:
    """name and metrics: a scene's own if it has any, else those of the study."""
    own = direct.filter(F.col("metrics").isNotNull()).select("name", F.col("metrics").alias("own"))
    rest = study.select("name", F.col("metrics").alias("other"))
    return own.join(rest, "name", "full").select("name", F.coalesce("own", "other").alias("metrics"))


def complete_tiles(assets: DataFrame, kinds: tuple[str, ...], resolution: str) -> DataFrame:
    """tile, kind, href for tiles that all ``kinds`` have: the asset of that resolution if there is one, else the first by name."""
    best = F.min_by("href", F.struct((F.col("resolution") != resolution), F.col("href")))
    own = assets.filter(F.col("kind").isin(*kinds)).groupBy("tile", "kind").agg(best.alias("href"))
    whole = own.groupBy("tile").agg(F.count("*").alias("n")).filter(F.col("n") == len(kinds))
    return own.join(whole, "tile", "left_semi")


def load_scale_model(spark: SparkSession, path: str, backbone: str) -> DataFrame:
    """The stored scale model of a backbone, or the default one (no backbone named); none for another's. Unknown keys are left out."""
    schema = "backbone string, kind string, value double, feature string, coef double, intercept double, radius_m double, n_scenes int"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    fits = F.coalesce("backbone", F.lit("")).isin(backbone, "")
    return rows.filter(fits).orderBy(F.col("backbone") == backbone, ascending=False).limit(1)


def read_px(spark: SparkSession, path: str, layers: list[str], nodata: float = -9999.0, stride: int = 1) -> DataFrame:
    """scene_id, row, col and the named layers that the table has, nodata as null, on every ``stride``-th pixel."""
    df = spark.read.parquet(path)
    cols = [F.when(F.col(c) != nodata, F.col(c)).alias(c) for c in layers if c in df.columns]
    grid = (F.col("row") % stride == 0) & (F.col("col") % stride == 0)
    return (df.filter(grid) if stride > 1 else df).select("scene_id", "row", "col", *cols)


def write_layers(px: DataFrame, path: str, layers: list[str], provenance: DataFrame | None = None) -> None:
    """Writes layers in long form, one folder for each scene and layer, so that a reader of one reads only that; ``provenance`` (a row a scene) goes beside them."""
    long = px.unpivot(["scene_id", "row", "col"], layers, "layer", "v").filter(F.col("v").isNotNull())
    long.repartition("scene_id", "layer").sortWithinPartitions("row", "col").write.partitionBy("scene_id", "layer").parquet(path)
    if provenance is not None:
        # Readers of the layers skip names that begin with an underscore.
        provenance.write.parquet(f"{path}/_provenance")


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_layers`` was told of each scene."""
    return spark.read.parquet(f"{path}/_provenance")
