"""Queries of inventories, elevation tiles, study records and anchor sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import anchors as harvest
from rasterloom.plans import study_queries
from rasterloom.plans.focal_queries import S_SQL
from rasterloom.plans.join_queries import _AB, _FIT, _HUBER, A_SQL, LINES_SQL, lines
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.score_queries import M_SQL, metres
from rasterloom.session import shared_folder
from rasterloom.sources import scenes, views

registry = Registry()
N = views.GRID
STEM = "'data/d' || (p_partkey // 4) % 7 || '/s' || p_partkey // 4"


@registry.add(
    f"""WITH f AS (SELECT {STEM} AS stem, ['.tif', '_dsm.tif', '_dem.tif', '.txt'][CAST(p_partkey % 4 AS INTEGER) + 1] AS e FROM part WHERE p_size % 5 <> 0),
w AS (SELECT stem, max(CASE WHEN e = '.tif' THEN stem || e END) AS image, max(CASE WHEN e = '_dsm.tif' THEN stem || e END) AS reference, max(CASE WHEN e = '_dem.tif' THEN stem || e END) AS dem FROM f GROUP BY stem)
SELECT regexp_extract(stem, '[^/]*$') AS name, image, reference, dem, NULL::VARCHAR AS dtm, NULL::VARCHAR AS semantics, 'dsm' AS reference_kind FROM w WHERE image IS NOT NULL"""
)
def scene_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    own = F.expr("cast(p_partkey div 4 as string)")
    stem = F.concat(F.lit("data/d"), F.expr("cast(p_partkey div 4 % 7 as string)"), F.lit("/s"), own)
    end = F.get(F.array(*(F.lit(e) for e in (".tif", "_dsm.tif", "_dem.tif", ".txt"))), (k % 4).cast("int"))
    return scenes.scene_inventory(views.read(spark, sf_dir, "part").filter("p_size % 5 <> 0").select(F.concat(stem, end).alias("path")))


@registry.add(
    """WITH b AS (SELECT c_custkey AS scene_id, c_custkey * 7 % 300 - 150 + 0.25 AS w, c_custkey * 3 % 120 - 60 + 0.5 AS s FROM customer)
SELECT scene_id, CAST(la.range AS INTEGER) AS lat, CAST(lo.range AS INTEGER) AS lon, 'Copernicus_DSM_COG_10_' || CASE WHEN la.range >= 0 THEN 'N' ELSE 'S' END || lpad(abs(la.range)::VARCHAR, 2, '0') || '_00_'
  || CASE WHEN lo.range >= 0 THEN 'E' ELSE 'W' END || lpad(abs(lo.range)::VARCHAR, 3, '0') || '_00_DEM' AS name
FROM b, range(-70, 80) la, range(-160, 170) lo WHERE la.range BETWEEN floor(s) AND floor(s + 1.25) AND lo.range BETWEEN floor(w) AND floor(w + 0.8)"""
)
def required_dem_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    w, s = k * 7 % 300 - 150 + 0.25, k * 3 % 120 - 60 + 0.5
    bounds = views.read(spark, sf_dir, "customer").select(k.alias("scene_id"), w.alias("w"), s.alias("s"), (w + 0.8).alias("e"), (s + 1.25).alias("n"))
    return scenes.required_dem_tiles(bounds)


_CELL = "CAST(l_orderkey // 1024 AS INTEGER) AS scene_id, CAST(l_orderkey % 64 AS INTEGER) AS \"row\", CAST(l_partkey % 64 AS INTEGER) AS col"


@registry.add(
    f"""WITH s AS (SELECT {_CELL}, (l_suppkey * 100000000 + l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS tile, CASE WHEN l_quantity > 10 THEN l_quantity END AS v FROM lineitem)
SELECT scene_id, "row", col, min_by(v, tile) FILTER (v IS NOT NULL) AS v FROM s GROUP BY ALL"""
)
def mosaic_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.read(spark, sf_dir, "lineitem")
    samples = li.select(
        views.scene_of("l_orderkey", views.ORDERS_A_SCENE), (F.col("l_orderkey") % N).cast("int").alias("row"), (F.col("l_partkey") % N).cast("int").alias("col"),
        ((F.col("l_suppkey") * 100_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")).alias("tile"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("v"),
    )
    return scenes.mosaic_dem(samples)


@registry.add(
    f"""WITH s AS (SELECT DISTINCT {_CELL} FROM lineitem WHERE l_quantity > 10), g AS (SELECT DISTINCT CAST(o_orderkey // 1024 AS INTEGER) AS scene_id FROM orders)
SELECT g.scene_id, round(count("row") / 4096, 6) AS coverage, CASE WHEN count("row") = 0 THEN 'no elevation tile covers the scene' END AS reason FROM g LEFT JOIN s ON s.scene_id = g.scene_id GROUP BY g.scene_id"""
)
def dem_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenes.dem_coverage(mosaic_dem(spark, sf_dir), views.full_grid(spark, sf_dir)))


@registry.add("""SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000)""")
def completed_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a finished order of their number: the work that is left."""
    todo = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), "p_name")
    orders = views.read(spark, sf_dir, "orders")
    metrics = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    summaries = orders.select(F.col("o_custkey").alias("name"), metrics.alias("metrics"), F.when(F.col("o_totalprice") > 1000, "x").alias("delivery"))
    return scenes.completed_scenes(todo, summaries, True).select(F.col("name").alias("p_partkey"), "p_name")


@registry.add("""WITH d AS (SELECT c_custkey AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS own FROM customer), s AS (SELECT p_partkey AS name, p_retailprice AS other FROM part)
SELECT coalesce(d.name, s.name) AS name, coalesce(own, other) AS metrics FROM (SELECT * FROM d WHERE own IS NOT NULL) d FULL JOIN s ON s.name = d.name""")
def phase2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("metrics"))
    study = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("metrics"))
    return scenes.phase2_summary(direct, study)


@registry.add(
    """WITH a AS (SELECT l_orderkey AS tile, l_returnflag AS kind, l_linestatus AS resolution, l_orderkey || '/' || l_partkey || '/' || l_linenumber AS href FROM lineitem),
b AS (SELECT tile, kind, href, row_number() OVER (PARTITION BY tile, kind ORDER BY resolution <> 'O', href) AS k FROM a)
SELECT tile, kind, href FROM b WHERE k = 1 QUALIFY count(*) OVER (PARTITION BY tile) = 3"""
)
def complete_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    li = views.read(spark, sf_dir, "lineitem")
    href = F.concat_ws("/", text("l_orderkey"), text("l_partkey"), text("l_linenumber"))
    assets = li.select(F.col("l_orderkey").alias("tile"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("resolution"), href.alias("href"))
    return scenes.complete_tiles(assets, ("A", "N", "R"), "O")


@registry.add()
def harvest_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.px(spark, sf_dir).select("scene_id", "row", "col", F.when(F.col("sem") <= 2, harvest.WATER).otherwise(0).alias("sem"), (F.col("ref_mm") / 1000.0).alias("h"))
    return rounded(harvest.harvest_water(px, N, "h", stride=4, least=20).select("scene_id", "row", "col", "value_m", "source", "weight"))


@registry.add(
    M_SQL
    + """, g AS (SELECT * FROM m WHERE sem IN (0, 1, 4)), q AS (SELECT scene_id, quantile_cont(pred, 0.2) AS level FROM g GROUP BY scene_id)
SELECT scene_id, "row", col, 0.0::DOUBLE AS value_m, 'ground_plane' AS source, 0.2::DOUBLE AS weight FROM g JOIN q USING (scene_id) WHERE pred <= level AND "row" % 4 = 0 AND col % 4 = 0"""
)
def ground_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.ground_plane(metres(spark, sf_dir), "pred", stride=4)


_REL_SQL = """, r AS (SELECT a.scene_id, (m.pred - n.pred) / 1000 AS d, (m.ref - n.ref) / 100 AS h, weight AS w0, weight AS w FROM anchors a
  JOIN m ON m.scene_id = a.scene_id AND m."row" = a."row" AND m.col = a.col JOIN m n ON n.scene_id = a.scene_id AND n."row" = a."row" AND n.col = 63 - a.col WHERE relative),"""
_REL_FIT = "SELECT scene_id, count(*) AS n, CASE WHEN count(*) >= 2 AND sum(w * d * d) >= 1e-12 THEN sum(w * d * h) / sum(w * d * d) ELSE 1 END AS a FROM {t} GROUP BY scene_id"
_REL_HUBER = "SELECT r.scene_id, d, h, w0, w0 * least(1, 2.0 / greatest(abs(a * d - h), 1e-9)) AS w FROM r JOIN {t} USING (scene_id)"


@registry.add(
    A_SQL
    + _REL_SQL
    + f"""f1 AS ({_REL_FIT.format(t="r")}), r2 AS ({_REL_HUBER.format(t="f1")}), f2 AS ({_REL_FIT.format(t="r2")}), r3 AS ({_REL_HUBER.format(t="f2")}), f3 AS ({_REL_FIT.format(t="r3")})
SELECT scene_id, n, round(CASE WHEN a > 0 THEN a ELSE 1 END, 4) AS a FROM f3"""
)
def global_affine_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = metres(spark, sf_dir).select("scene_id", "row", "col", "pred", "ref")
    own = views.anchors(spark, sf_dir).filter("relative").select("scene_id", "row", "col", "weight").join(px, ["scene_id", "row", "col"])
    mirror = px.select("scene_id", "row", (N - 1 - F.col("col")).alias("col"), F.col("pred").alias("p2"), F.col("ref").alias("r2"))
    both = own.join(mirror, ["scene_id", "row", "col"]).select("scene_id", "weight", ((F.col("pred") - F.col("p2")) / 1000).alias("dd"), ((F.col("ref") - F.col("r2")) / 100).alias("value_m"))
    return rounded(harvest.global_affine_relative(both), 4)


@registry.add(
    S_SQL
    + f""", {LINES_SQL}, n AS (SELECT *, CAST(greatest(ceil(2 * greatest(abs(r1 - r0), abs(c1 - c0))), 1) AS INTEGER) AS n, CAST(round_even(least(line_id % 40, 30) / 2.0 / 2 - 0.5, 0) AS INTEGER) AS rad FROM lines WHERE line_id % 3 <> 0),
s AS (SELECT DISTINCT scene_id, line_id, CAST(round_even(r0 + k.range / n * (r1 - r0), 0) AS INTEGER) AS y, CAST(round_even(c0 + k.range / n * (c1 - c0), 0) AS INTEGER) AS x, greatest(rad, 0) AS rad FROM n, range(200) k WHERE k.range <= n),
road AS (SELECT DISTINCT scene_id, CAST(y + i.range AS INTEGER) AS "row", CAST(x + j.range AS INTEGER) AS col FROM s, range(-8, 9) i, range(-8, 9) j
  WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 AND i.range * i.range + j.range * j.range <= rad * rad AND y + i.range BETWEEN 0 AND 63 AND x + j.range BETWEEN 0 AND 63)
SELECT p.scene_id, p."row", p.col, CASE WHEN sem = 4 THEN 4 WHEN g < 30 THEN 2 WHEN r.scene_id IS NOT NULL THEN 1 ELSE sem END AS refined FROM px p LEFT JOIN road r ON r.scene_id = p.scene_id AND r."row" = p."row" AND r.col = p.col"""
)
def refine_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes corrected by footprints (dark pixels) and by roads of up to 30 m."""
    px = views.px(spark, sf_dir)
    own = lines(spark, sf_dir).withColumns({"width_m": (F.col("line_id") % 40).cast("double"), "elevated": F.col("line_id") % 3 == 0})
    road = harvest.road_mask(own, N, N, 2.0)
    return harvest.refine_semantics(px.select("scene_id", "row", "col", "sem"), px.filter("g < 30"), road).select("scene_id", "row", "col", "refined")


@registry.add(
    f"""WITH {views.PX_SQL}, o AS ({registry.sql["refine_semantics"]})
SELECT scene_id, count(*) AS n_px, count(*) FILTER (refined <> sem AND refined = 2) AS to_building, count(*) FILTER (refined <> sem AND refined = 1) AS to_road, count(*) FILTER (sem = 4) AS water_kept,
  round(avg(CAST(refined <> sem AS INTEGER)), 6) AS changed_fraction FROM o JOIN px USING (scene_id, "row", col) GROUP BY scene_id"""
)
def refine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What footprints and roads change, by scene."""
    sem = views.px(spark, sf_dir).select("scene_id", "row", "col", "sem")
    return rounded(harvest.refine_report(refine_semantics(spark, sf_dir).join(sem, ["scene_id", "row", "col"])))


@registry.add(f"""WITH {views.ANCHORS_SQL} SELECT "row", col, value_mm / 1000.0 AS elev_m, source AS label FROM anchors""")
def read_gcps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey points, written as CSV with names in other cases and read back."""
    path = f"{shared_folder(spark)}/gcps-{uuid.uuid4().hex}"
    own = views.anchors(spark, sf_dir).select(F.col("row").alias("Row"), F.col("col").alias("COL"), (F.col("value_mm") / 1000.0).alias("Elev"), F.col("source").alias("Label"))
    own.write.option("header", "true").csv(path)
    return scenes.read_gcps(spark, path)


@registry.add()
def extract_dtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    sem = views.px_full(spark, sf_dir).select("scene_id", "row", "col", "sem")
    own = views.surface(spark, sf_dir).join(sem, ["scene_id", "row", "col"])
    return rounded(harvest.extract_dtm(own, "z", N, N, 2.0, 12.0).select("scene_id", "row", "col", "dtm"), 5)


@registry.add(
    A_SQL
    + f""", b AS (SELECT a.scene_id, source, pred / 1000 AS d, ref / 100 AS h, weight AS w0 FROM anchors a JOIN m ON m.scene_id = a.scene_id AND m."row" = a."row" AND m.col = a.col WHERE NOT relative),
r AS (SELECT b.scene_id, v.variant, d, h, w0, w0 AS w FROM b JOIN (VALUES ('all'), ('urgent'), ('no_low')) v(variant) ON v.variant = 'all' OR (v.variant = 'urgent' AND source IN ('1', '2')) OR (v.variant = 'no_low' AND source <> '5')),
s1 AS ({_FIT.format(by="scene_id, variant", t="r")}), f1 AS ({_AB.format(t="s1").replace("scene_id, n", "scene_id, variant, n")}),
r2 AS ({_HUBER.format(t="f1").replace("r.scene_id, d", "r.scene_id, r.variant, d").replace("USING (scene_id)", "USING (scene_id, variant)")}), s2 AS ({_FIT.format(by="scene_id, variant", t="r2")}),
f2 AS ({_AB.format(t="s2").replace("scene_id, n", "scene_id, variant, n")}), r3 AS ({_HUBER.format(t="f2").replace("r.scene_id, d", "r.scene_id, r.variant, d").replace("USING (scene_id)", "USING (scene_id, variant)")}),
s3 AS ({_FIT.format(by="scene_id, variant", t="r3")}), f3 AS ({_AB.format(t="s3").replace("scene_id, n", "scene_id, variant, n")}),
o AS (SELECT f3.scene_id, variant, n, a, mh - a * md AS b0, avg(abs(a * d + mh - a * md - h)) AS mae FROM f3 JOIN b USING (scene_id) GROUP BY ALL)
SELECT scene_id, variant, n, round(a, 3) AS a, round(b0, 3) AS b, round(mae, 3) AS mae_m, row_number() OVER (PARTITION BY scene_id ORDER BY mae, variant) = 1 AS best FROM o"""
)
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.anchors(spark, sf_dir).filter(~F.col("relative")).select("scene_id", "row", "col", "source", "weight")
    at = own.join(metres(spark, sf_dir).select("scene_id", "row", "col", "pred", "ref"), ["scene_id", "row", "col"]).withColumns({"d": F.col("pred") / 1000, "value_m": F.col("ref") / 100})
    return rounded(harvest.ablation(at, {"all": None, "urgent": ("1", "2"), "no_low": ("1", "2", "3", "4")}), 3)


@registry.add(
    """WITH f AS (SELECT s_suppkey * 10 AS feature_id, 'building' AS kind, s_suppkey % 7 AS n, * FROM supplier WHERE s_suppkey % 7 >= 4 UNION ALL SELECT s_suppkey * 10 + 1, 'road', s_suppkey % 5, * FROM supplier WHERE s_suppkey % 5 >= 2
UNION ALL SELECT s_suppkey * 10 + 2, 'building', s_suppkey % 6, * FROM supplier WHERE s_suppkey % 6 >= 4)
SELECT s_suppkey AS scene_id, feature_id, kind, s_name AS name, CAST(n AS INTEGER) AS n_pts, CAST(s_nationkey * n + n * (n - 1) // 2 AS DOUBLE) AS lat_sum FROM f"""
)
def read_osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map payloads as JSON, one a supplier with a building, a road and a relation of an outer and an inner ring, some of them too short to count."""
    k = F.col("s_suppkey")

    def line(n):
        steps = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < n)
        return F.transform(steps, lambda i: F.struct((F.col("s_nationkey") + i).cast("double").alias("lat"), i.cast("double").alias("lon")))

    none = F.lit(None)
    members = F.array(
        F.struct(F.when(k % 2 == 0, "outer").alias("role"), F.lit("way").alias("type"), line(k % 6).alias("geometry")),
        F.struct(F.lit("inner").alias("role"), F.lit("way").alias("type"), line(F.lit(5)).alias("geometry")),
    )
    shape = "array<struct<role: string, type: string, geometry: array<struct<lat: double, lon: double>>>>"
    element = lambda kind, i, tag, geometry, rings: F.struct(
        F.lit(kind).alias("type"), (k * 10 + i).alias("id"), F.create_map(F.lit(tag), F.lit("yes"), F.lit("name"), F.col("s_name")).alias("tags"),
        geometry.cast("array<struct<lat: double, lon: double>>").alias("geometry"), rings.cast(shape).alias("members"),
    )
    elements = F.array(element("way", 0, "building", line(k % 7), none), element("way", 1, "highway", line(k % 5), none), element("relation", 2, "building", none, members))
    payload = views.read(spark, sf_dir, "supplier").select(k.alias("scene_id"), F.to_json(F.struct(elements.alias("elements"))).alias("json"))
    out = scenes.read_osm(payload)
    total = F.aggregate("pts", F.lit(0.0), lambda s, p: s + p["lat"])
    return out.select("scene_id", "feature_id", "kind", F.col("tags")["name"].alias("name"), F.size("pts").alias("n_pts"), total.alias("lat_sum"))


@registry.add(f"SELECT 'large' AS backbone, kind, value, CAST(n_scenes AS INTEGER) AS n_scenes FROM ({study_queries.registry.sql['fit_scale']})")
def load_scale_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale fitted to all scenes, stored for one backbone beside a default and one of another, and read back."""
    path = f"{shared_folder(spark)}/scale-{uuid.uuid4().hex}"
    fitted = study_queries.fit_scale(spark, sf_dir).withColumn("backbone", F.explode(F.array(F.lit("small"), F.lit(""), F.lit("large"))))
    fitted.withColumn("value", F.when(F.col("backbone") == "large", F.col("value")).otherwise(0.0)).write.option("maxRecordsPerFile", 1).json(path)
    return scenes.load_scale_model(spark, path, "large").select("backbone", "kind", "value", "n_scenes")
