"""Queries of calibrated, filtered and shadowed surfaces, chips, scale features and stored layers."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import anchors, focal, scores, surfaces, tiling
from rasterloom.plans.focal_queries import _KERNEL_SQL, MIRROR, S_SQL, _box_sql_nearest
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.score_queries import M_SQL, metres
from rasterloom.session import shared_folder
from rasterloom.sources import scenes, views

registry = Registry()
N = views.GRID
LOW_SQL = f""", k(o, w) AS (VALUES {_KERNEL_SQL}), ga AS (
  SELECT g.scene_id, g."row", g.col, sum(k.w * s.z) AS v FROM grid g, k JOIN surface s ON s.scene_id = g.scene_id AND s."row" = g."row" AND s.col = {MIRROR.format("g.col + k.o")} GROUP BY ALL
), low AS (SELECT g.scene_id, g."row", g.col, sum(k.w * s.v) AS low FROM grid g, k JOIN ga s ON s.scene_id = g.scene_id AND s.col = g.col AND s."row" = {MIRROR.format('g."row" + k.o')} GROUP BY ALL),
bands AS (SELECT scene_id, "row", col, z, z - low AS high FROM surface JOIN low USING (scene_id, "row", col))"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface and its high band."""
    return focal.gaussian(views.surface(spark, sf_dir), "z", 1.5, N, N).withColumn("high", F.col("z") - F.col("low")).drop("low")


@registry.add(S_SQL + LOW_SQL + ', f AS (SELECT scene_id, sqrt(avg(z)) AS a, min(z) AS b FROM surface GROUP BY scene_id) SELECT scene_id, "row", col, round(a * z + b, 5) AS raw_m, round(a * high + b, 5) AS height_m FROM bands JOIN f USING (scene_id)')
def apply_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights from depth, and from the high band of a dual-branch field, by one line a scene."""
    own = bands(spark, sf_dir)
    fit = own.groupBy("scene_id").agg(F.sqrt(F.avg("z")).alias("a"), F.min("z").alias("b"))
    out = surfaces.apply_calibration(own.join(fit, "scene_id"), "z", name="raw_m")
    return rounded(surfaces.apply_calibration(out, "z", "high").select("scene_id", "row", "col", "raw_m", "height_m"), 5)


@registry.add(
    S_SQL
    + f""", g AS (SELECT s.scene_id, CAST(y.range AS INTEGER) AS "row", CAST(x.range AS INTEGER) AS col, least(greatest((y.range + 0.5) * 1.6 - 0.5, 0), {N - 1}) AS sy, least(greatest((x.range + 0.5) * 1.6 - 0.5, 0), {N - 1}) AS sx
  FROM (SELECT DISTINCT scene_id FROM grid) s, range(40) y, range(40) x), i AS (SELECT *, least(floor(sy), {N - 2}) AS r0, least(floor(sx), {N - 2}) AS c0 FROM g)
SELECT i.scene_id, i."row", i.col, round(sum((CASE WHEN a.range = 1 THEN sy - r0 ELSE 1 - sy + r0 END) * (CASE WHEN b.range = 1 THEN sx - c0 ELSE 1 - sx + c0 END) * z), 8) AS z
FROM i, range(2) a, range(2) b JOIN surface s ON s.scene_id = i.scene_id AND s."row" = r0 + a.range AND s.col = c0 + b.range GROUP BY i.scene_id, i."row", i.col"""
)
def downscale_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surfaces.downscale(views.surface(spark, sf_dir), "z", N, N, 40), 8)


@registry.add(f"WITH {views.SCENES_SQL.strip()} SELECT scene_id, [t[1] * 1.6, t[2] * 1.6, t[3], t[4] * 1.6, t[5] * 1.6, t[6]] AS transform, crs FROM (SELECT *, transform AS t FROM scenes) WHERE t IS NOT NULL")
def downscale_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surfaces.downscale_scenes(views.scenes(spark, sf_dir).filter("transform is not null"), N, N, 40)
    return out.select("scene_id", F.transform("transform", lambda x: x + F.lit(0.0)).alias("transform"), "crs")


_GUIDE = S_SQL + ', gs AS (SELECT scene_id, "row", col, z AS s, (coalesce(0.299 * r + 0.587 * g + 0.114 * b, 0)) / 255.0::DOUBLE AS g FROM px_full JOIN surface USING (scene_id, "row", col)), '
_GUIDED_SQL = (
    _GUIDE
    + 'gp AS (SELECT *, g * s AS gs, g * g AS gg FROM gs), '
    + ", ".join(f"m{v} AS ({_box_sql_nearest(v, 'gp', 2)})" for v in ("s", "g", "gs", "gg"))
    + """, ab AS (SELECT scene_id, "row", col, (mgs.m - mg.m * ms.m) / (mgg.m - mg.m * mg.m + 0.01) AS a, ms.m - (mgs.m - mg.m * ms.m) / (mgg.m - mg.m * mg.m + 0.01) * mg.m AS b
  FROM ms JOIN mg USING (scene_id, "row", col) JOIN mgs USING (scene_id, "row", col) JOIN mgg USING (scene_id, "row", col)), """
    + ", ".join(f"n{v} AS ({_box_sql_nearest(v, 'ab', 2)})" for v in ("a", "b"))
    + """, out AS (SELECT scene_id, "row", col, s, na.m * g + nb.m AS q FROM gs JOIN na USING (scene_id, "row", col) JOIN nb USING (scene_id, "row", col)) """
)


def guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    lum = F.coalesce(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"), F.lit(0.0)) / 255.0
    px = views.px_full(spark, sf_dir).select("scene_id", "row", "col", (F.coalesce("ref_mm", F.lit(0)) % 100_000 / 1000.0).alias("s"), lum.alias("g"))
    return surfaces.guided_filter(px, "s", "g", 2, 0.01, N, N, "q")


@registry.add(_GUIDED_SQL + 'SELECT scene_id, "row", col, round(q, 4) + 0::DOUBLE AS q FROM out')
def guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface smoothed, with the edges of luminance kept."""
    return rounded(guided(spark, sf_dir).select("scene_id", "row", "col", "q"), 4)


@registry.add(
    _GUIDED_SQL
    + f""", dz AS (SELECT scene_id, "row", col, s, q - s AS dz FROM out), nd AS ({_box_sql_nearest("dz", "dz", 4)}), cl AS (SELECT scene_id, 0.25 * quantile_cont(s, 0.99) AS c FROM out GROUP BY 1)
SELECT scene_id, "row", col, round(greatest(s + least(greatest(dz - nd.m, -c), c), 0) + 1e-7, 4) + 0::DOUBLE AS refined FROM dz JOIN nd USING (scene_id, "row", col) JOIN cl USING (scene_id)"""
)
def refine_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights sharpened along edges of luminance, their mean over four metres around held; a bit more is told, so that no tie of rounding falls on a value."""
    lum = F.coalesce(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"), F.lit(0.0)) / 255.0
    px = views.px_full(spark, sf_dir).select("scene_id", "row", "col", (F.coalesce("ref_mm", F.lit(0)) % 100_000 / 1000.0).alias("s"), lum.alias("g"))
    return rounded(surfaces.refine_heights(px, "s", "g", N, N, 1.0, 2.0, 0.01, preserve=4.0).select("scene_id", "row", "col", (F.col("refined") + 1e-7).alias("refined")), 4)


@registry.add(_GUIDED_SQL + "SELECT scene_id, round(max(abs(q - s)), 4) AS max_abs_m, round(sqrt(avg((q - s) * (q - s))), 4) AS rms_m, round(avg(CAST(abs(q - s) > 0.05 AS INTEGER)), 4) AS moved_fraction FROM out GROUP BY scene_id")
def refine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surfaces.refine_stats(guided(spark, sf_dir).withColumn("d", F.col("q") - F.col("s")), "d"), 4)


@registry.add(
    S_SQL
    + f""", v AS (SELECT scene_id, "row", col, coalesce(sem, 0) AS sem, coalesce(g, 255) < 90 AS dark FROM px_full), m AS (SELECT g.scene_id, g."row", g.col, quantile_disc(s.sem, 0.5) AS m FROM v g, range(-2, 3) y, range(-2, 3) x
  JOIN v s ON s.scene_id = g.scene_id AND s."row" = {MIRROR.format('g."row" + y.range')} AND s.col = {MIRROR.format("g.col + x.range")} WHERE g.dark GROUP BY ALL)
SELECT scene_id, "row", col, coalesce(m, sem) AS filled FROM v LEFT JOIN m USING (scene_id, "row", col)"""
)
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of dark pixels by the median of their 5 x 5 box."""
    px = views.px_full(spark, sf_dir).select("scene_id", "row", "col", F.coalesce("sem", F.lit(0)).alias("sem"), (F.coalesce("g", F.lit(255)) < 90).alias("dark"))
    return surfaces.median_fill(px, "sem", "dark", (0, 1, 2, 3, 4), N, N, 5).select("scene_id", "row", "col", "filled")


_AZ, _EL = 137.0, 41.0
_DC, _DR, _DZ = math.cos(math.radians(_EL)) * math.sin(math.radians(_AZ)), -math.cos(math.radians(_EL)) * math.cos(math.radians(_AZ)), math.sin(math.radians(_EL))


@registry.add(
    S_SQL
    + f""", p AS (SELECT s.*, k.range AS k, least(greatest("row" + {_DR!r} * k.range, 0), {N - 1}) AS y, least(greatest(col + {_DC!r} * k.range, 0), {N - 1}) AS x FROM surface s, range(1, 13) k),
q AS (SELECT *, least(floor(y), {N - 2}) AS y0, least(floor(x), {N - 2}) AS x0 FROM p)
SELECT q.scene_id, q."row", q.col, bool_or((1 - (y - y0)) * ((1 - (x - x0)) * a.z + (x - x0) * b.z) + (y - y0) * ((1 - (x - x0)) * c.z + (x - x0) * d.z) > q.z + {_DZ!r} * k * 2.0 + 1e-3) AS shadow FROM q
JOIN surface a ON a.scene_id = q.scene_id AND a."row" = y0 AND a.col = x0 JOIN surface b ON b.scene_id = q.scene_id AND b."row" = y0 AND b.col = x0 + 1
JOIN surface c ON c.scene_id = q.scene_id AND c."row" = y0 + 1 AND c.col = x0 JOIN surface d ON d.scene_id = q.scene_id AND d."row" = y0 + 1 AND d.col = x0 + 1 GROUP BY ALL"""
)
def cast_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.cast_shadow(views.surface(spark, sf_dir), "z", _AZ, _EL, 2.0, N, N, 12, 32)


_FEATURES_SQL = S_SQL + LOW_SQL + """, f AS (SELECT b.scene_id, round(quantile_cont(round(high, 3), 0.99), 3) AS hi_p99, round(stddev_pop(high), 4) AS hi_std, round(quantile_cont(z, 0.99) - quantile_cont(z, 0.01), 6) AS rd_range, 0.5::DOUBLE AS gsd_m FROM bands b GROUP BY scene_id),
d AS (SELECT scene_id, round(quantile_cont(pred_mm / 1000.0, 0.99) - quantile_cont(pred_mm / 1000.0, 0.01), 6) AS dem_relief_m FROM px GROUP BY scene_id)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = views.px(spark, sf_dir).select("scene_id", "row", "col", (F.col("pred_mm") / 1000.0).alias("dem"))
    out = surfaces.scene_features(bands(spark, sf_dir).join(dem, ["scene_id", "row", "col"], "left"), "z", "high", "dem", 0.5)
    return out.select("scene_id", F.round("hi_p99", 3).alias("hi_p99"), F.round("hi_std", 4).alias("hi_std"), F.round("rd_range", 6).alias("rd_range"), "gsd_m", F.round("dem_relief_m", 6).alias("dem_relief_m"))


@registry.add(_FEATURES_SQL + " SELECT * FROM f LEFT JOIN d USING (scene_id)")
def scene_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir)


@registry.add(_FEATURES_SQL + " SELECT scene_id, CASE WHEN hi_std - 25 > 0 THEN round(hi_std - 25, 3) END AS scale, CASE WHEN hi_std - 25 <= 0 THEN 'not positive' END AS refused FROM f")
def fitted_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales by a model of one feature; those that aren't positive are refused."""
    model = views.read(spark, sf_dir, "region").limit(1).select(F.lit("base").alias("backbone"), F.lit(60.0).alias("radius_m"), F.lit(-25.0).alias("intercept"), F.lit(1.0).alias("coef"))
    return rounded(surfaces.fitted_scale(features(spark, sf_dir).withColumn("x", F.col("hi_std")), model, "base", 60.0), 3)


_LINE = "SELECT scene_id, n, mr, ms, CASE WHEN var < 1e-8 THEN 1 ELSE cov / var END AS s FROM (SELECT scene_id, count(*) AS n, sum(w * x) / sum(w) AS ms, sum(w * y) / sum(w) AS mr, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS var, sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w) AS cov FROM {t} GROUP BY scene_id)"


@registry.add(
    M_SQL
    + f""", r AS (SELECT scene_id, pred / 100 AS x, ref / 100 AS y, 1 / sigma AS w FROM m), l AS ({_LINE.format(t="r")}),
e AS (SELECT r.*, abs(s * x + mr - s * ms - y) AS e FROM r JOIN l USING (scene_id)), d AS (SELECT scene_id, greatest(1.4826 * quantile_cont(round(e, 6), 0.5), 1e-4) AS d FROM e GROUP BY scene_id),
r2 AS (SELECT e.scene_id, x, y, w * least(1, d / greatest(e, 1e-12)) AS w FROM e JOIN d USING (scene_id)), l2 AS ({_LINE.format(t="r2")})
SELECT scene_id, n, round(least(greatest(s, 0.05), 20), 4) AS s, round(mr - s * ms, 3) AS t FROM l2"""
)
def overlap_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scene the robust line that brings predicted to reference heights, in hectometres."""
    pairs = metres(spark, sf_dir).select("scene_id", (F.col("pred") / 100).alias("x"), (F.col("ref") / 100).alias("y"), (1 / F.col("sigma")).alias("w"))
    out = surfaces.overlap_affine(pairs, "x", "y", "w", ("scene_id",))
    return out.select("scene_id", "n", F.round("s", 4).alias("s"), F.round("t", 3).alias("t"))


@registry.add(S_SQL + ' SELECT scene_id, "row", col, (r * 2 + g + b)::DOUBLE AS depth FROM px')
def chip_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor (twice red plus green plus blue) over chips of 32 pixels."""
    return surfaces.chip_apply(views.px(spark, sf_dir).select("scene_id", "row", "col", "r", "g", "b"), ("r", "g", "b"), 32, lambda c: c.astype(float) @ [2.0, 1.0, 1.0])


@registry.add(S_SQL + """, l AS (SELECT scene_id, CAST(l.range AS INTEGER) AS lod, z AS v FROM surface, range(4) l WHERE "row" % (1 << l.range) = 0 AND col % (1 << l.range) = 0),
e AS (SELECT scene_id, min(v) AS lo, CASE WHEN max(v) - min(v) < 1e-12 THEN min(v) + 1 ELSE max(v) END AS hi FROM l GROUP BY scene_id)
SELECT l.scene_id, lod, 'z' AS layer, round(max(abs(round_even((v + 10000) / 0.1, 0) * 0.1 - 10000 - v)), 6) AS terrain_error, round(max(abs(lo + round_even((v - lo) / (hi - lo) * 16777215, 0) / 16777215 * (hi - lo) - v)), 6) AS linear_error, true AS within
FROM l JOIN e USING (scene_id) GROUP BY l.scene_id, lod""")
def roundtrip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tiling.roundtrip_report(views.surface(spark, sf_dir), ["z"], 4, N, N))


@registry.add(M_SQL + """, e AS (SELECT scene_id, avg(abs(err)) AS mae_m, sqrt(avg(err * err)) AS rmse_m, avg(err) AS bias_m FROM m GROUP BY scene_id),
l AS (SELECT 1 AS place, 'mae_m' AS metric, mae_m AS v FROM e UNION ALL SELECT 2, 'rmse_m', rmse_m FROM e UNION ALL SELECT 3, 'bias_m', bias_m FROM e)
SELECT CAST(place AS INTEGER) AS place, metric, printf('%.2f', avg(v)) AS mean, printf('%.2f', min(v)) AS least, printf('%.2f', max(v)) AS most FROM l GROUP BY ALL""")
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of metrics over scenes, in fixed order."""
    return scores.metrics_table(scores.evaluate(metres(spark, sf_dir)), ("mae_m", "rmse_m", "bias_m"), 2)


@registry.add(M_SQL + ' SELECT scene_id, "row", col, ref AS value_m, \'gcp\' AS source, 1.0::DOUBLE AS weight FROM m WHERE sem = 1')
def harvest_gcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metres(spark, sf_dir).filter("sem = 1").select("scene_id", "row", "col", F.col("ref").alias("elev_m"))
    return anchors.harvest_gcp(points)


@registry.add(M_SQL + """, a AS (SELECT scene_id, 'gcp' AS source FROM m WHERE sem = 1 UNION ALL SELECT scene_id, 'dem' FROM m WHERE sem IN (0, 4) AND "row" % 4 = 0 AND col % 4 = 0) SELECT scene_id, source, count(*) AS n FROM a GROUP BY ALL""")
def build_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many anchors each source gives a scene, in one union."""
    from rasterloom.operators import joins

    dem = joins.harvest_dem(metres(spark, sf_dir), "ref", (0, 4), 4)
    return anchors.build_anchors(harvest_gcp(spark, sf_dir), dem)[1]


@registry.add(S_SQL + ' SELECT scene_id, "row", col, ref_mm::DOUBLE AS ref, CASE WHEN sem <> 3 THEN sem::DOUBLE END AS sem FROM px WHERE "row" % 2 = 0 AND col % 2 = 0')
def read_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers written with a nodata value and read back on every second pixel."""
    path = f"{shared_folder(spark)}/px-{uuid.uuid4().hex}"
    px = views.px(spark, sf_dir).select("scene_id", "row", "col", F.col("ref_mm").cast("double").alias("ref"), F.when(F.col("sem") == 3, -9999.0).otherwise(F.col("sem").cast("double")).alias("sem"))
    px.write.parquet(path)
    return scenes.read_px(spark, path, ["ref", "sem", "missing"], stride=2)


@registry.add(S_SQL + """ SELECT scene_id, "row", col, 'g' AS layer, g AS v FROM px UNION ALL SELECT scene_id, "row", col, 'sem', sem FROM px""")
def write_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers written by scene and name, and read back."""
    path = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    scenes.write_layers(views.px(spark, sf_dir), path, ["g", "sem"])
    return spark.read.parquet(path).select("scene_id", "row", "col", "layer", "v")


@registry.add("""SELECT DISTINCT '{"scene":' || o_orderkey || ',"value":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE (o_orderkey % 7)::VARCHAR || '.5' END || '}' AS json FROM orders""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON; numbers that aren't finite are null."""
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(k % 7 + 0.5)
    return scenes.strict_json(views.read(spark, sf_dir, "orders").select(k.alias("scene"), value.alias("value")))
