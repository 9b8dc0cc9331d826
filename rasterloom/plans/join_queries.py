"""Queries of joins between pixels, anchors, lattices, lines and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import focal, graph, joins
from rasterloom.plans.focal_queries import S_SQL, _grad_sql
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.score_queries import M_SQL, metres
from rasterloom.session import spread
from rasterloom.sources import views

registry = Registry()
N = views.GRID
A_SQL = f"{M_SQL.rstrip()}, {views.ANCHORS_SQL.strip()} "
LINES_SQL = """lines AS (SELECT CAST(s_suppkey AS BIGINT) AS line_id, CAST(s_suppkey // 7 AS INTEGER) AS scene_id, (s_suppkey * 7 % 50)::DOUBLE AS r0, (s_suppkey * 11 % 60)::DOUBLE AS c0,
  (s_nationkey * 2.5)::DOUBLE AS r1, (s_suppkey % 64 * 0.75)::DOUBLE AS c1 FROM supplier)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = views.read(spark, sf_dir, "supplier").select(
        k.alias("line_id"), views.scene_of("s_suppkey", views.SUPPLIERS_A_SCENE), (k * 7 % 50).cast("double").alias("r0"), (k * 11 % 60).cast("double").alias("c0"),
        (F.col("s_nationkey") * 2.5).alias("r1"), (k % 64 * 0.75).alias("c1"),
    )
    return spread(own, "scene_id", "line_id")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped rings, one for each supplier."""
    k = F.col("s_suppkey")
    y, x, a = (k * 7 % 50).cast("double") - 0.5, (k * 11 % 50).cast("double") - 0.5, F.col("s_nationkey") % 9 + 3.0
    point = lambda r, c: F.struct(r.alias("y"), c.alias("x"))
    ring = [(y, x), (y, x + a), (y + a / 2, x + a), (y + a / 2, x + a / 3), (y + a, x + a / 3), (y + a, x)]
    own = views.read(spark, sf_dir, "supplier").select(k.alias("feature_id"), views.scene_of("s_suppkey", views.SUPPLIERS_A_SCENE), F.array(*(point(*p) for p in ring)).alias("pts"))
    return spread(own, "scene_id", "feature_id")


POLY_SQL = """base AS (SELECT CAST(s_suppkey AS BIGINT) AS feature_id, CAST(s_suppkey // 7 AS INTEGER) AS scene_id, (s_suppkey * 7 % 50) - 0.5::DOUBLE AS y, (s_suppkey * 11 % 50) - 0.5::DOUBLE AS x, (s_nationkey % 9 + 3)::DOUBLE AS a FROM supplier),
corners AS (SELECT feature_id, scene_id, k, py, px FROM base, (VALUES (0)) v(z), LATERAL (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([y, y, y + a / 2, y + a / 2, y + a, y + a]) AS py, unnest([x, x + a, x + a, x + a / 3, x + a / 3, x]) AS px)),
edges AS (SELECT a.feature_id, a.scene_id, a.py AS y0, a.px AS x0, b.py AS y1, b.px AS x1 FROM corners a JOIN corners b ON b.feature_id = a.feature_id AND b.k = (a.k + 1) % 6)"""


@registry.add(A_SQL + """SELECT anchor_id, a.scene_id, a."row", a.col, ref AS at_pixel FROM anchors a LEFT JOIN m ON m.scene_id = a.scene_id AND m."row" = a."row" AND m.col = a.col""")
def sample_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.anchors(spark, sf_dir).select("anchor_id", "scene_id", "row", "col")
    return joins.sample_at(metres(spark, sf_dir), points, "ref", "at_pixel").select("anchor_id", "scene_id", "row", "col", "at_pixel")


@registry.add(
    S_SQL
    + f""", g AS ({_grad_sql("z", 100.0)}), k AS (SELECT g.*, p.sem FROM g JOIN px_full p USING (scene_id, "row", col))
SELECT scene_id, "row", col, z AS value_m, 'dem' AS source, 0.6::DOUBLE AS weight FROM k
WHERE "row" % 4 = 0 AND col % 4 = 0 AND sem IN (0, 1, 4) AND NOT degrees(atan(sqrt(gx * gx + gy * gy))) > 25"""
)
def harvest_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    sem = views.px_full(spark, sf_dir).select("scene_id", "row", "col", "sem")
    sloped = focal.slope_deg(views.surface(spark, sf_dir), "z", 100.0).join(sem, ["scene_id", "row", "col"])
    return joins.harvest_dem(sloped, "z", (0, 1, 4), 4, F.col("slope") > 25)


@registry.add(
    S_SQL
    + f""", n AS (SELECT scene_id, least(CAST("row" AS INTEGER) // 8, {(N - 1 + 7) // 8 - 1}) AS r0, least(col // 8, {(N - 1 + 7) // 8 - 1}) AS c0, "row", col FROM grid),
l AS (SELECT scene_id, (CAST("row" AS INTEGER) + 7) // 8 AS node_r, (CAST(col AS INTEGER) + 7) // 8 AS node_c, z AS a, z / 4 + node_r AS b FROM surface
  WHERE ("row" % 8 = 0 OR "row" = {N - 1}) AND (col % 8 = 0 OR col = {N - 1}))
SELECT n.scene_id, n."row", n.col, round(sum((CASE WHEN i.range = 1 THEN n."row" / 8 - r0 ELSE 1 - n."row" / 8 + r0 END) * (CASE WHEN j.range = 1 THEN n.col / 8 - c0 ELSE 1 - n.col / 8 + c0 END) * a), 12) AS a,
  round(sum((CASE WHEN i.range = 1 THEN n."row" / 8 - r0 ELSE 1 - n."row" / 8 + r0 END) * (CASE WHEN j.range = 1 THEN n.col / 8 - c0 ELSE 1 - n.col / 8 + c0 END) * b), 12) AS b
FROM n, range(2) i, range(2) j JOIN l ON l.scene_id = n.scene_id AND l.node_r = r0 + i.range AND l.node_c = c0 + j.range GROUP BY ALL"""
)
def lattice_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice of every eighth pixel and the last, brought to all pixels."""
    on = lambda c: (F.col(c) % 8 == 0) | (F.col(c) == N - 1)
    nodes = views.surface(spark, sf_dir).filter(on("row") & on("col"))
    node_r, node_c = F.expr("cast((row + 7) div 8 as int)"), F.expr("cast((col + 7) div 8 as int)")
    lattice = nodes.select("scene_id", node_r.alias("node_r"), node_c.alias("node_c"), F.col("z").alias("a"), (F.col("z") / 4 + node_r).alias("b"))
    own = views.surface(spark, sf_dir).select("scene_id", "row", "col")
    return rounded(joins.lattice_upsample(lattice, own, 8, N, N), 12)


@registry.add(
    S_SQL
    + f""", {LINES_SQL}, p AS (
  SELECT line_id, scene_id, CAST(k.range AS INTEGER) AS step, k.range / 31 * sqrt(pow(r1 - r0, 2) + pow(c1 - c0, 2)) AS distance_m,
    least(greatest(r0 + k.range / 31 * (r1 - r0), 0), {N - 1}) AS y, least(greatest(c0 + k.range / 31 * (c1 - c0), 0), {N - 1}) AS x FROM lines, range(32) k
), q AS (SELECT *, least(floor(y), {N - 2}) AS yr, least(floor(x), {N - 2}) AS xr FROM p)
SELECT line_id, step, round(distance_m, 8) AS distance_m, round(sum((CASE WHEN i.range = 1 THEN y - yr ELSE 1 - y + yr END) * (CASE WHEN j.range = 1 THEN x - xr ELSE 1 - x + xr END) * z), 8) AS elevation_m
FROM q, range(2) i, range(2) j JOIN surface s ON s.scene_id = q.scene_id AND s."row" = yr + i.range AND s.col = xr + j.range GROUP BY line_id, step, distance_m"""
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.profile(views.surface(spark, sf_dir), lines(spark, sf_dir), "z", N, N, n=32), 8)


@registry.add(
    f"""WITH {POLY_SQL}, hit AS (
  SELECT feature_id, scene_id, r.range AS "row", x0 + (r.range - y0) * (x1 - x0) / (y1 - y0) AS x FROM edges, range({N}) r WHERE r.range >= least(y0, y1) AND r.range < greatest(y0, y1)
) SELECT scene_id, feature_id, CAST("row" AS INTEGER) AS "row", CAST(c.range AS INTEGER) AS col FROM hit, range({N}) c
GROUP BY ALL HAVING count(*) FILTER (x < c.range) % 2 = 1 OR count(*) FILTER (x = c.range) > 0"""
)
def fill_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fill_polygon(polygons(spark, sf_dir), N, N)


@registry.add(
    f"""WITH {POLY_SQL}, s AS (SELECT scene_id, feature_id, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area,
  sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * sin(4 * atan2(y1 - y0, x1 - x0))) AS s, sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * cos(4 * atan2(y1 - y0, x1 - x0))) AS c FROM edges GROUP BY ALL)
SELECT scene_id, feature_id, round(area, 6) AS area, round(round(degrees(atan2(s, c)) / 4 + 90, 6) % 90, 6) AS angle_deg FROM s"""
)
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(joins.polygon_area(polygons(spark, sf_dir)))
    return out.withColumn("angle_deg", F.col("angle_deg") % 90)


@registry.add(
    f"""WITH {LINES_SQL}, n AS (SELECT *, CAST(greatest(ceil(2 * greatest(abs(r1 - r0), abs(c1 - c0))), 1) AS INTEGER) AS n FROM lines),
s AS (SELECT line_id, scene_id, CAST(round_even(r0 + k.range / n * (r1 - r0), 0) AS INTEGER) AS "row", CAST(round_even(c0 + k.range / n * (c1 - c0), 0) AS INTEGER) AS col FROM n, range(200) k WHERE k.range <= n)
SELECT DISTINCT * FROM s WHERE "row" BETWEEN 0 AND {N - 1} AND col BETWEEN 0 AND {N - 1}"""
)
def draw_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.draw_line(lines(spark, sf_dir), N, N)


_FIT = """SELECT {by}, sum(w) AS sw, sum(w * d) AS sd, sum(w * h) AS sh, sum(w * d * d) AS sdd, sum(w * d * h) AS sdh, count(*) AS n FROM {t} GROUP BY {by}"""
_AB = """SELECT scene_id, n, CASE WHEN n < 2 OR sdd / sw - pow(sd / sw, 2) < 1e-12 THEN 1 ELSE (sdh / sw - sd / sw * sh / sw) / (sdd / sw - pow(sd / sw, 2)) END AS a,
  sh / sw AS mh, sd / sw AS md FROM {t}"""
_HUBER = """SELECT r.scene_id, d, h, w0, w0 * least(1, 2.0 / greatest(abs(a * d + (mh - a * md) - h), 1e-9)) AS w FROM r JOIN {t} f USING (scene_id)"""


@registry.add(
    A_SQL
    + f""", r AS (SELECT a.scene_id, pred / 1000 AS d, ref / 100 AS h, weight AS w0, weight AS w FROM anchors a JOIN m ON m.scene_id = a.scene_id AND m."row" = a."row" AND m.col = a.col WHERE NOT relative),
s1 AS ({_FIT.format(by="scene_id", t="r")}), f1 AS ({_AB.format(t="s1")}), r2 AS ({_HUBER.format(t="f1")}), s2 AS ({_FIT.format(by="scene_id", t="r2")}), f2 AS ({_AB.format(t="s2")}),
r3 AS ({_HUBER.format(t="f2")}), s3 AS ({_FIT.format(by="scene_id", t="r3")}), f3 AS ({_AB.format(t="s3")})
SELECT scene_id, round(a, 4) AS a, round(CASE WHEN n < 2 THEN 0 ELSE mh - a * md END, 4) AS b, n FROM f3"""
)
def global_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.anchors(spark, sf_dir).filter(~F.col("relative")).select("anchor_id", "scene_id", "row", "col", "weight")
    at = own.join(metres(spark, sf_dir), ["scene_id", "row", "col"]).withColumns({"d": F.col("pred") / 1000, "value_m": F.col("ref") / 100})
    return rounded(joins.global_affine(at), 4)


@registry.add(
    S_SQL
    + """, k AS (SELECT scene_id, "row", col FROM px_full WHERE g < 75), e AS (
  SELECT a.scene_id, a."row" * 64 + a.col AS a, b."row" * 64 + b.col AS b FROM k a JOIN k b ON b.scene_id = a.scene_id AND abs(a."row" - b."row") + abs(a.col - b.col) <= 1
), reach AS (SELECT * FROM (WITH RECURSIVE r(scene_id, a, b) AS (SELECT scene_id, a, a FROM e UNION SELECT r.scene_id, r.a, e.b FROM r JOIN e ON e.scene_id = r.scene_id AND e.a = r.b) SELECT * FROM r)),
c AS (SELECT scene_id, a, min(b) AS b, count(*) AS n FROM reach GROUP BY scene_id, a)
SELECT scene_id, CAST(a // 64 AS INTEGER) AS "row", CAST(a % 64 AS INTEGER) AS col, scene_id::BIGINT * 1000000000000 + b AS component FROM c WHERE n >= 2"""
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(views.px(spark, sf_dir).filter("g < 75"), N, 2)


@registry.add(
    S_SQL
    + """, v AS (SELECT * FROM px_full WHERE ref_mm IS NOT NULL), h AS (SELECT scene_id, "row", col FROM px_full WHERE ref_mm IS NULL),
d AS (SELECT h.scene_id, h."row", h.col, min_by(v.ref_mm, (pow(v."row" - h."row", 2) + pow(v.col - h.col, 2)) * 10000 + v."row" * 100 + v.col) AS near
  FROM h JOIN v ON v.scene_id = h.scene_id GROUP BY ALL)
SELECT scene_id, "row", col, coalesce(p.ref_mm, near) AS filled FROM px_full p LEFT JOIN d USING (scene_id, "row", col)"""
)
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hole of every scene takes the value of the nearest pixel."""
    return joins.nearest_fill(views.px_full(spark, sf_dir).select("scene_id", "row", "col", "ref_mm"), "ref_mm").select("scene_id", "row", "col", "filled")
