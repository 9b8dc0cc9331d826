"""Queries of resampling, point look-ups, instance summaries, levels of detail and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import instances, joins
from rasterloom.plans.focal_queries import S_SQL
from rasterloom.plans.mesh_queries import PAINT_SQL, masks
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.score_queries import ERRORS_SQL, M_SQL, metres
from rasterloom.sources import views

registry = Registry()
N = views.GRID


@registry.add(
    S_SQL
    + f""", g AS (SELECT s.scene_id, CAST(y.range AS INTEGER) AS "row", CAST(x.range AS INTEGER) AS col, y.range * 1.75 - 3 AS sy, x.range * 1.25 + 0.5 AS sx FROM (SELECT DISTINCT scene_id FROM grid) s, range(40) y, range(48) x),
i AS (SELECT *, least(floor(sy), {N - 2}) AS r0, least(floor(sx), {N - 2}) AS c0 FROM g WHERE sy BETWEEN 0 AND {N - 1} AND sx BETWEEN 0 AND {N - 1}),
v AS (SELECT i.scene_id, i."row", i.col, sum((CASE WHEN a.range = 1 THEN sy - r0 ELSE 1 - sy + r0 END) * (CASE WHEN b.range = 1 THEN sx - c0 ELSE 1 - sx + c0 END) * z) AS v FROM i, range(2) a, range(2) b
  JOIN surface s ON s.scene_id = i.scene_id AND s."row" = r0 + a.range AND s.col = c0 + b.range GROUP BY ALL)
SELECT g.scene_id, g."row", g.col, round(v, 8) AS v FROM g LEFT JOIN v USING (scene_id, "row", col)"""
)
def resample_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear values of a coarser, shifted grid; null outside the source."""
    grid = views.full_grid(spark, sf_dir, 40, 48)
    at = grid.withColumns({"y": F.col("row") * 1.75 - 3, "x": F.col("col") * 1.25 + 0.5})
    inside = at.filter(F.col("y").between(0, N - 1) & F.col("x").between(0, N - 1))
    points = inside.select("scene_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), "y", "x")
    found = joins.bilinear_at(views.surface(spark, sf_dir), points, "z", N, N, "v").select("scene_id", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "v")
    return rounded(grid.join(found, ["scene_id", "row", "col"], "left"), 8)


@registry.add(
    S_SQL
    + f""", g AS (SELECT s.scene_id, CAST(y.range AS INTEGER) AS "row", CAST(x.range AS INTEGER) AS col, y.range * 1.75 - 3 AS y, x.range * 1.25 + 0.5 AS x FROM (SELECT DISTINCT scene_id FROM grid) s, range(40) y, range(48) x)
SELECT g.scene_id, g."row", g.col, p.sem FROM g LEFT JOIN px_full p ON p.scene_id = g.scene_id AND p."row" = round_even(g.y, 0) AND p.col = round_even(g.x, 0) AND g.y BETWEEN 0 AND {N - 1} AND g.x BETWEEN 0 AND {N - 1}"""
)
def resample_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes on a coarser, shifted grid, each from the nearest pixel; null outside the source."""
    points = views.full_grid(spark, sf_dir, 40, 48).withColumns({"y": F.col("row") * 1.75 - 3, "x": F.col("col") * 1.25 + 0.5})
    return joins.nearest_at(views.px_full(spark, sf_dir), points, "sem", N, N, "sem").select("scene_id", "row", "col", "sem")


@registry.add(
    M_SQL
    + """, q AS (SELECT o_orderkey, CAST(o_orderkey // 1024 AS INTEGER) AS scene_id, (o_orderkey % 80) * 0.5 + 0.25 AS x, -((o_orderkey // 7) % 80) * 0.5 - 0.25 AS y FROM orders)
SELECT o_orderkey, ref, sigma, err FROM q LEFT JOIN m ON m.scene_id = q.scene_id AND m.col = CAST(floor(x / 0.5) AS INTEGER) AND m."row" = CAST(floor(-y / 0.5) AS INTEGER)"""
)
def pixel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation, sigma and error at world points of half-metre rasters; null outside."""
    o = F.col("o_orderkey")
    t = F.array(*(F.lit(v) for v in (0.5, 0.0, 0.0, 0.0, -0.5, 0.0)))
    x, y = (o % 80) * 0.5 + 0.25, -(F.expr("o_orderkey div 7") % 80) * 0.5 - 0.25
    row, col = geo.world_to_pixel(t, x, y)
    points = views.read(spark, sf_dir, "orders").select("o_orderkey", views.scene_of("o_orderkey", views.ORDERS_A_SCENE), F.rint(row).cast("int").alias("row"), F.rint(col).cast("int").alias("col"))
    px = metres(spark, sf_dir).select("scene_id", "row", "col", "ref", "sigma", "err")
    return points.join(px, ["scene_id", "row", "col"], "left").select("o_orderkey", "ref", "sigma", "err")


@registry.add(PAINT_SQL + f"""SELECT r.scene_id, count(DISTINCT r.instance) AS n_instances, round(count(DISTINCT s."row" * {N} + s.col) / {N * N}, 6) AS coverage, round(avg(r.area_px / 100), 6) AS mean_confidence
FROM s JOIN r ON r.scene_id = s.scene_id AND r.instance = s.instance GROUP BY r.scene_id""")
def instance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scene: instances that show, share of pixels under one, and their mean score over covered pixels (here a hundredth of the area)."""
    # An instance covers as many pixels as it shows, so no pixel meets its record.
    records = instances.paint_instances(masks(spark, sf_dir), 12)[0].filter("visible_px > 0")
    covered = F.sum("visible_px")
    return rounded(
        records.groupBy("scene_id").agg(
            F.count("*").alias("n_instances"), (covered / (N * N)).alias("coverage"), (F.sum(F.col("visible_px") * F.col("area_px")) / 100 / covered).alias("mean_confidence")
        )
    )


@registry.add(
    """WITH l AS (SELECT c_custkey, l.range AS lod, ((200 + c_custkey % 5000) >> l.range) * ((300 + c_custkey * 7 % 9000) >> l.range) AS n FROM customer, range(6) l)
SELECT c_custkey, CAST(coalesce(min(lod) FILTER (n <= 1600000), max(lod)) AS INTEGER) AS lod FROM l GROUP BY c_custkey"""
)
def pick_lod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest level of detail whose pixels fit the budget, else the coarsest."""
    k = F.col("c_custkey")
    sizes = views.read(spark, sf_dir, "customer").select("c_custkey", (200 + k % 5000).alias("h"), (300 + k * 7 % 9000).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lod"))
    n = F.expr("shiftright(h, lod) * shiftright(w, lod)")
    return sizes.groupBy("c_custkey").agg(F.coalesce(F.min(F.when(n <= 1_600_000, F.col("lod"))), F.max("lod")).alias("lod"))


@registry.add(M_SQL + f""", e AS (SELECT scene_id, sem, {ERRORS_SQL} FROM m GROUP BY scene_id, sem) SELECT scene_id, sem, n_px, mae_m FROM e QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY mae_m DESC, sem) <= 2""")
def worst_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two classes of largest error of each scene (a top-k report)."""
    from rasterloom.operators import scores

    out = rounded(scores.evaluate(metres(spark, sf_dir), by=("scene_id", "sem")))
    order = W.partitionBy("scene_id").orderBy(F.desc("mae_m"), "sem")
    return out.withColumn("k", F.row_number().over(order)).filter("k <= 2").select("scene_id", "sem", "n_px", "mae_m")


@registry.add(
    M_SQL
    + """, l AS (SELECT scene_id, 'ref' AS layer, ref AS v FROM m UNION ALL SELECT scene_id, 'h_ref', h_ref FROM m),
s AS (SELECT scene_id, layer, max(v) AS most, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM l GROUP BY ALL)
SELECT scene_id, layer, note FROM (SELECT *, unnest([CASE WHEN p99 < 2 THEN 'flat_surface' END, CASE WHEN p99 < 8 THEN 'low_relief' END, CASE WHEN most > 8 * p95 THEN 'spiky' END, CASE WHEN most > 100 THEN 'tall' END]) AS note FROM s) WHERE note IS NOT NULL"""
)
def derive_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that a layer's own values give: flat, low relief, spiky, tall."""
    from rasterloom.operators import scores

    s = scores.finite_stats(metres(spark, sf_dir), ["ref", "h_ref"])
    note = [
        F.when(F.col("p99") < 2, "flat_surface"), F.when(F.col("p99") < 8, "low_relief"),
        F.when(F.col("most") > 8 * F.col("p95"), "spiky"), F.when(F.col("most") > 100, "tall"),
    ]
    return s.select("scene_id", "layer", F.explode(F.array_compact(F.array(*note))).alias("note"))
