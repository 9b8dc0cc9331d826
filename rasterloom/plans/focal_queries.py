"""Queries of neighbourhood operators on the dense surface view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import focal, scenery
from rasterloom.plans.registry import Registry, rounded
from rasterloom.sources import views

registry = Registry()
N = views.GRID
S_SQL = f"WITH {views.FULL_SQL}"
#: Mirror of an index that may lie outside, the edge doubled.
MIRROR = f"CASE WHEN {{0}} < 0 THEN -1 - ({{0}}) WHEN {{0}} >= {N} THEN {2 * N - 1} - ({{0}}) ELSE {{0}} END"


def _grad_sql(v: str, gsd: float = 1.0, table: str = "surface") -> str:
    """gx and gy of a view, by shifted joins."""
    return f"""SELECT s.*, (coalesce(e.{v}, s.{v}) - coalesce(w.{v}, s.{v})) / (CASE WHEN e.{v} IS NULL OR w.{v} IS NULL THEN 1 ELSE 2 END * {gsd}) AS gx,
      (coalesce(d.{v}, s.{v}) - coalesce(u.{v}, s.{v})) / (CASE WHEN d.{v} IS NULL OR u.{v} IS NULL THEN 1 ELSE 2 END * {gsd}) AS gy
    FROM {table} s LEFT JOIN {table} e ON e.scene_id = s.scene_id AND e."row" = s."row" AND e.col = s.col + 1
    LEFT JOIN {table} w ON w.scene_id = s.scene_id AND w."row" = s."row" AND w.col = s.col - 1
    LEFT JOIN {table} d ON d.scene_id = s.scene_id AND d."row" = s."row" + 1 AND d.col = s.col
    LEFT JOIN {table} u ON u.scene_id = s.scene_id AND u."row" = s."row" - 1 AND u.col = s.col"""


@registry.add(S_SQL + f', g AS ({_grad_sql("z", 0.5)}) SELECT scene_id, "row", col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g')
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.slope_deg(views.surface(spark, sf_dir), "z", 0.5).drop("z"))


@registry.add(S_SQL + f', g AS ({_grad_sql("z", 0.5)}) SELECT scene_id, "row", col, round((degrees(atan2(-gx, gy)) + 360) % 360, 6) AS aspect FROM g')
def aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.aspect_deg(views.surface(spark, sf_dir), "z", 0.5).drop("z"))


@registry.add(S_SQL + f', g AS ({_grad_sql("z")}) SELECT scene_id, "row", col, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g')
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.gradient(views.surface(spark, sf_dir)).drop("z"))


def _box_sql(v: str, table: str, r: int) -> str:
    return f"""SELECT g.scene_id, g."row", g.col, avg(s.{v}) AS m FROM grid g, range(-{r}, {r + 1}) y, range(-{r}, {r + 1}) x
      JOIN {table} s ON s.scene_id = g.scene_id AND s."row" = {MIRROR.format('g."row" + y.range')} AND s.col = {MIRROR.format("g.col + x.range")} GROUP BY ALL"""


def _box_sql_nearest(v: str, table: str, r: int) -> str:
    at = f"least(greatest({{0}}, 0), {N - 1})"
    return f"""SELECT g.scene_id, g."row", g.col, avg(s.{v}) AS m FROM grid g, range(-{r}, {r + 1}) y, range(-{r}, {r + 1}) x
      JOIN {table} s ON s.scene_id = g.scene_id AND s."row" = {at.format('g."row" + y.range')} AND s.col = {at.format("g.col + x.range")} GROUP BY ALL"""


@registry.add(S_SQL + f', m AS ({_box_sql("z", "surface", 3)}) SELECT scene_id, "row", col, round(m, 6) AS mean FROM m')
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.box_mean(views.surface(spark, sf_dir), "z", 3, N, N).drop("z"))


@registry.add(S_SQL + f', m AS ({_box_sql_nearest("z", "surface", 2)}) SELECT scene_id, "row", col, round(m, 6) AS mean FROM m')
def box_mean_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.box_mean(views.surface(spark, sf_dir), "z", 2, N, N, edge="nearest").drop("z"))


@registry.add(
    S_SQL
    + f""", m AS ({_box_sql("z", "surface", 2)}), d AS (SELECT scene_id, "row", col, pow(z - m, 2) AS d FROM surface JOIN m USING (scene_id, "row", col)),
q AS ({_box_sql("d", "d", 2)}) SELECT scene_id, "row", col, round(sqrt(greatest(m, 0)), 5) AS roughness FROM q"""
)
def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.roughness(views.surface(spark, sf_dir), "z", N, N, 5).drop("z"), 5)


_SIGMA = 1.5
_RADIUS = int(4 * _SIGMA + 0.5)
_KERNEL = [math.exp(-0.5 * (k / _SIGMA) ** 2) for k in range(-_RADIUS, _RADIUS + 1)]
_KERNEL_SQL = ", ".join(f"({k - _RADIUS}, {x / sum(_KERNEL)!r}::DOUBLE)" for k, x in enumerate(_KERNEL))


@registry.add(
    S_SQL
    + f""", k(o, w) AS (VALUES {_KERNEL_SQL}), a AS (
  SELECT g.scene_id, g."row", g.col, sum(k.w * s.z) AS v FROM grid g, k JOIN surface s ON s.scene_id = g.scene_id AND s."row" = g."row" AND s.col = {MIRROR.format("g.col + k.o")} GROUP BY ALL
), c AS (
  SELECT g.scene_id, g."row", g.col, sum(k.w * s.v) AS v FROM grid g, k JOIN a s ON s.scene_id = g.scene_id AND s.col = g.col AND s."row" = {MIRROR.format('g."row" + k.o')} GROUP BY ALL
) SELECT scene_id, "row", col, round(v, 5) AS low, round(z - v, 5) AS high FROM c JOIN surface USING (scene_id, "row", col)"""
)
def decompose_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gaussian low band of a surface and what is left, the high band."""
    out = focal.gaussian(views.surface(spark, sf_dir), "z", _SIGMA, N, N)
    return rounded(out.withColumn("high", F.col("z") - F.col("low")).drop("z"), 5)


@registry.add(
    S_SQL
    + f""", o AS (SELECT y.range AS y, x.range AS x FROM range(-1, 2) y, range(-1, 2) x WHERE y.range <> 0 OR x.range <> 0)
SELECT s.scene_id, s."row", s.col, round(avg(abs(s.z - t.z)), 6) AS tri FROM surface s, o JOIN surface t ON t.scene_id = s.scene_id
  AND t."row" = (s."row" + o.y + {N}) % {N} AND t.col = (s.col + o.x + {N}) % {N} GROUP BY ALL"""
)
def tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.tri(views.surface(spark, sf_dir), "z", N, N).drop("z"))


_MASK_SQL = S_SQL + ', k AS (SELECT scene_id, "row", col, coalesce(g, 255) < 90 AS m FROM px_full)'
_NEAR = """JOIN k t ON t.scene_id = s.scene_id AND t."row" BETWEEN s."row" - {r} AND s."row" + {r} AND t.col BETWEEN s.col - {r} AND s.col + {r}"""


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.px_full(spark, sf_dir).select("scene_id", "row", "col", (F.coalesce("g", F.lit(255)) < 90).alias("m"))


@registry.add(
    _MASK_SQL
    + f"""SELECT s.scene_id, s."row", s.col, bool_or(t.m) AS dilated, count(*) FILTER (t.m) = 9 AS eroded FROM k s {_NEAR.format(r=1)} GROUP BY ALL"""
)
def dilate_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.erode(focal.dilate(_mask(spark, sf_dir), "m", 1, "dilated"), "m", 1, "eroded").drop("m")


@registry.add(
    _MASK_SQL
    + f""", e AS (SELECT s.scene_id, s."row", s.col, count(*) FILTER (t.m) = 9 AS m FROM k s {_NEAR.format(r=1)} GROUP BY ALL),
d AS (SELECT s.scene_id, s."row", s.col, bool_or(t.m) AS m FROM k s {_NEAR.format(r=1)} GROUP BY ALL),
o AS (SELECT s.scene_id, s."row", s.col, bool_or(t.m) AS opened FROM e s {_NEAR.format(r=1).replace("k t", "e t")} GROUP BY ALL),
c AS (SELECT s.scene_id, s."row", s.col, count(*) FILTER (t.m) = 9 AS closed FROM d s {_NEAR.format(r=1).replace("k t", "d t")} GROUP BY ALL)
SELECT * FROM o JOIN c USING (scene_id, "row", col)"""
)
def open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.closed(focal.opened(_mask(spark, sf_dir), "m", 1, "opened"), "m", 1, "closed").drop("m")


@registry.add(
    S_SQL
    + """, v AS (SELECT scene_id, "row", col, sem FROM px_full)
SELECT s.scene_id, s."row", s.col, bool_or(s.sem IS DISTINCT FROM t.sem) AS boundary FROM v s JOIN v t ON t.scene_id = s.scene_id
  AND ((t."row" = s."row" AND abs(t.col - s.col) = 1) OR (t.col = s.col AND abs(t."row" - s."row") = 1)) GROUP BY ALL"""
)
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.boundaries(views.px_full(spark, sf_dir).select("scene_id", "row", "col", "sem"), "sem").drop("sem")


_SIDES_SQL = S_SQL + """, both_ AS (SELECT scene_id, "row", col, coalesce(pred_mm, 0) % 100000 / 1000.0 AS pred, coalesce(ref_mm, 0) % 100000 / 1000.0 AS ref FROM px_full)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    mm = lambda c: F.coalesce(c, F.lit(0)) % 100_000 / 1000.0
    return views.px_full(spark, sf_dir).select("scene_id", "row", "col", mm("pred_mm").alias("pred"), mm("ref_mm").alias("ref"))


@registry.add(
    _SIDES_SQL
    + f""", p AS ({_grad_sql("pred", 1.0, "both_")}), r AS ({_grad_sql("ref", 1.0, "both_")})
SELECT scene_id, round(avg(abs(degrees(atan(sqrt(p.gx * p.gx + p.gy * p.gy))) - degrees(atan(sqrt(r.gx * r.gx + r.gy * r.gy))))), 6) AS slope_mae_deg
FROM p JOIN r USING (scene_id, "row", col) GROUP BY scene_id"""
)
def slope_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenery.slope_mae(_sides(spark, sf_dir), "pred", "ref"))


@registry.add(
    _SIDES_SQL
    + f""", p AS ({_grad_sql("pred", 1.0, "both_")}), r AS ({_grad_sql("ref", 1.0, "both_")}), m AS (
  SELECT scene_id, "row", col, sqrt(p.gx * p.gx + p.gy * p.gy) AS mp, sqrt(r.gx * r.gx + r.gy * r.gy) AS mr FROM p JOIN r USING (scene_id, "row", col)
), q AS (SELECT scene_id, quantile_cont(mp, 0.92) AS qp, quantile_cont(mr, 0.92) AS qr FROM m GROUP BY scene_id),
k AS (SELECT scene_id, "row", col, mp > qp AS p, mr > qr AS r FROM m JOIN q USING (scene_id)),
d AS (SELECT s.scene_id, s."row", s.col, any_value(s.p) AS p, any_value(s.r) AS r, bool_or(t.p) AS dp, bool_or(t.r) AS dr FROM k s {_NEAR.format(r=2)} GROUP BY s.scene_id, s."row", s.col),
n AS (SELECT scene_id, count(*) FILTER (p) AS np, count(*) FILTER (r) AS nr, count(*) FILTER (p AND dr) AS hp, count(*) FILTER (r AND dp) AS hr FROM d GROUP BY scene_id)
SELECT scene_id, round(2 * (hp / np) * (hr / nr) / ((hp / np) + (hr / nr)), 6) AS edge_f1, np AS n_pred_edges, nr AS n_ref_edges FROM n"""
)
def edge_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.edge_f1(_sides(spark, sf_dir), "pred", "ref"))


@registry.add(
    S_SQL
    + """, r AS (SELECT scene_id, "row", col, g, rank() OVER (PARTITION BY scene_id ORDER BY g) AS k, count(*) OVER (PARTITION BY scene_id, g) AS t,
  count(*) OVER (PARTITION BY scene_id) AS n FROM px_full WHERE g IS NOT NULL)
SELECT scene_id, "row", col, round(coalesce((k - 1 + (t - 1) / 2.0) / (n - 1), 0), 6) AS rank01 FROM grid LEFT JOIN r USING (scene_id, "row", col)"""
)
def rank_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.px_full(spark, sf_dir).select("scene_id", "row", "col", "g")
    return rounded(focal.rank_normalise(own, "g", ("scene_id",)).drop("g"))


@registry.add(
    S_SQL
    + """SELECT scene_id, CAST("row" // (1 << l.range) AS INTEGER) AS "row", CAST(col // (1 << l.range) AS INTEGER) AS col, z, CAST(l.range AS INTEGER) AS lod
FROM surface, range(6) l WHERE "row" % (1 << l.range) = 0 AND col % (1 << l.range) = 0"""
)
def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.pyramid(views.surface(spark, sf_dir), 6, N, N)


@registry.add(
    S_SQL
    + f""", b AS (SELECT y.range AS br, x.range AS bc, y.range * 8 AS y0, x.range * 8 AS x0, least(y.range * 8 + 8, {N - 1}) AS y1, least(x.range * 8 + 8, {N - 1}) AS x1 FROM range({(N - 2) // 8 + 1}) y, range({(N - 2) // 8 + 1}) x),
c AS (SELECT b.*, nw.scene_id, nw.z AS nw, ne.z AS ne, sw.z AS sw, se.z AS se FROM b JOIN surface nw ON nw."row" = y0 AND nw.col = x0
  JOIN surface ne ON ne.scene_id = nw.scene_id AND ne."row" = y0 AND ne.col = x1 JOIN surface sw ON sw.scene_id = nw.scene_id AND sw."row" = y1 AND sw.col = x0
  JOIN surface se ON se.scene_id = nw.scene_id AND se."row" = y1 AND se.col = x1),
e AS (SELECT c.*, s.z, (s."row" - y0) / (y1 - y0) AS u, (s.col - x0) / (x1 - x0) AS v FROM c JOIN surface s ON s.scene_id = c.scene_id AND s."row" BETWEEN y0 AND y1 AND s.col BETWEEN x0 AND x1)
SELECT scene_id, CAST(br AS INTEGER) AS br, CAST(bc AS INTEGER) AS bc, round(max(abs(z - ((1 - u) * ((1 - v) * nw + v * ne) + u * ((1 - v) * sw + v * se)))), 6) AS error FROM e GROUP BY ALL"""
)
def block_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.block_error(views.surface(spark, sf_dir), "z", N, N))
