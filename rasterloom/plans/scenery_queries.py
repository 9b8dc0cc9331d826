"""Queries of shadows and what they measure, prominence, land cover, outlines and the separation of meshes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import footprints, graph, instances, mesh, scenery
from rasterloom.plans.focal_queries import MIRROR, S_SQL
from rasterloom.plans.focal_queries import registry as focal_registry
from rasterloom.plans.footprint_queries import registry as footprint_registry
from rasterloom.plans.join_queries import registry as join_registry
from rasterloom.plans.mesh_queries import MASK_SQL, masks
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.score_queries import M_SQL, metres
from rasterloom.session import written_pixels
from rasterloom.sources import views

registry = Registry()
N = views.GRID
AZIMUTH, ELEVATION = 140.0, 40.0
_DR, _DC = (f"({x!r}::DOUBLE)" for x in scenery.anti_solar(AZIMUTH))
_TAN = f"({math.tan(math.radians(ELEVATION))!r}::DOUBLE)"
BLOB_SQL = join_registry.sql["connected_components"]
_ISOLATION_SQL = footprint_registry.sql["isolation_score"].replace("round(1 - count(c.component) / count(*), 6)", "1 - count(c.component) / count(*)")
_STEP = lambda c, d, k: f"CAST(round_even({c} + {d} * {k}, 0) AS INTEGER)"
RUNS_SQL = f"""WITH {views.PX_SQL}, c AS MATERIALIZED ({BLOB_SQL}), bld AS (SELECT scene_id, "row" AS y, col AS x, 1 AS hit FROM px WHERE g < 75),
dark AS (SELECT scene_id, "row" AS y, col AS x, 1 AS hit FROM px WHERE b >= 150),
edge AS (SELECT c.scene_id, c.component, c."row", c.col FROM c LEFT JOIN bld ON bld.scene_id = c.scene_id AND bld.y = least(greatest({_STEP('c."row"', _DR, 1)}, 0), {N - 1})
  AND bld.x = least(greatest({_STEP("c.col", _DC, 1)}, 0), {N - 1}) WHERE bld.hit IS NULL),
walk AS (SELECT e.*, k.range AS k, {_STEP('e."row"', _DR, "k.range")} AS y, {_STEP("e.col", _DC, "k.range")} AS x FROM edge e, range(1, {N + 1}) k),
met AS (SELECT w.scene_id, w.component, w."row", w.col, min(k) FILTER (bld.hit = 1) AS stop, list(k ORDER BY k) FILTER (bld.hit IS NULL AND dark.hit = 1) AS ks FROM walk w
  LEFT JOIN bld ON bld.scene_id = w.scene_id AND bld.y = w.y AND bld.x = w.x LEFT JOIN dark ON dark.scene_id = w.scene_id AND dark.y = w.y AND dark.x = w.x
  WHERE w.y BETWEEN 0 AND {N - 1} AND w.x BETWEEN 0 AND {N - 1} GROUP BY ALL),
runs AS (SELECT e.scene_id, e.component, e."row", e.col, CAST(list_reduce(list_prepend(0::BIGINT, list_filter(coalesce(ks, []), lambda k: k < coalesce(stop, {N + 1}))), lambda p, k: CASE WHEN k - p - 1 <= 2 THEN k ELSE p END) AS INTEGER) AS length
  FROM edge e LEFT JOIN met USING (scene_id, component, "row", col))
"""


def _shaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled buildings (two pixels or more), all building pixels, and shadow pixels."""
    px = written_pixels(views.px(spark, sf_dir).select("scene_id", "row", "col", "g", "b").filter("g < 75 or b >= 150"), "shaded-pixels")
    return graph.connected_components(px.filter("g < 75"), N, 2), px.filter("g < 75"), px.filter("b >= 150")


@registry.add(RUNS_SQL + "SELECT * FROM runs")
def shadow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenery.shadow_runs(*_shaded(spark, sf_dir), AZIMUTH, N, N, N)


@registry.add(
    RUNS_SQL
    + f""", r AS (SELECT * FROM runs WHERE length >= 2), m AS (SELECT scene_id, component, median(length) AS len, count(*) AS n, list("row" ORDER BY "row", col) AS ys, list(col ORDER BY "row", col) AS xs FROM r GROUP BY ALL HAVING count(*) >= 4),
d AS (SELECT scene_id, component, median(abs(length - len)) AS mad FROM r JOIN m USING (scene_id, component) GROUP BY ALL),
s AS (SELECT scene_id, component, CAST(round_even(avg("row"), 0) AS INTEGER) AS "row", CAST(round_even(avg(col), 0) AS INTEGER) AS col FROM c GROUP BY ALL), i AS ({_ISOLATION_SQL}),
o AS (SELECT scene_id, component, "row", col, len * 1.0 * {_TAN} AS height, least(greatest(1 - mad / greatest(len, 1e-6), 0), 1) * coalesce(isolation, 1) AS weight, n AS n_runs,
  least(greatest({_STEP("ys[n // 2 + 1]", _DR, 2)}, 0), {N - 1}) AS ref_row, least(greatest({_STEP("xs[n // 2 + 1]", _DC, 2)}, 0), {N - 1}) AS ref_col
  FROM m JOIN d USING (scene_id, component) JOIN s USING (scene_id, component) LEFT JOIN i USING (scene_id, component))
SELECT scene_id, component, "row", col, round(height, 6) AS height_m, round(weight, 6) AS weight, n_runs, ref_row, ref_col FROM o WHERE height BETWEEN 1 AND 400 AND weight > 0.02"""
)
def harvest_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenery.harvest_shadow(*_shaded(spark, sf_dir), AZIMUTH, ELEVATION, 1.0, N, N, heights=(1.0, 400.0), ring=5))


@registry.add(
    S_SQL
    + f""", o AS (SELECT y.range AS y, x.range AS x FROM range(-2, 3) y, range(-2, 3) x)
SELECT g.scene_id, g."row", g.col, round(any_value(g.z) - list_sort(list(s.z))[3], 6) + 0::DOUBLE AS prominence FROM surface g, o
JOIN surface s ON s.scene_id = g.scene_id AND s."row" = {MIRROR.format('g."row" + o.y')} AND s.col = {MIRROR.format("g.col + o.x")} GROUP BY ALL"""
)
def prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenery.prominence(views.surface(spark, sf_dir), "z", N, N, 5))


@registry.add()
def detect_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast shadows of every scene, whose patches of 8 x 8 have the colour and class of their first pixel; tests hold the operator against brute force."""
    patch = [F.expr(f"{c} div 8").alias(f"p_{c}") for c in ("row", "col")]
    keys = ["scene_id", "p_row", "p_col"]
    first = views.px(spark, sf_dir).groupBy("scene_id", *patch).agg(F.min_by(F.struct("r", "g", "b", "sem"), F.struct("row", "col")).alias("c"))
    px = views.full_grid(spark, sf_dir).select("*", *patch).join(first, keys, "left").select("scene_id", "row", "col", "c.*")
    return scenery.detect_shadow(px, N, N)


@registry.add()
def segment_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover of every scene, by heights and without them; tests hold the operator against brute force."""
    px = views.px_full(spark, sf_dir).withColumn("up", F.col("ref_mm") % 5000 / 1000.0).withColumn("shade", F.coalesce(F.col("b") >= 200, F.lit(False)))
    out = scenery.segment_heuristic(px, N, N, "up", "shade")
    return scenery.segment_heuristic(out, N, N, name="cover_plain").select("scene_id", "row", "col", "cover", "cover_plain")


@registry.add(
    MASK_SQL
    + """SELECT m.scene_id, m.mask_id, round(count(*) FILTER ((b - 128) / 40.0 > 1) / greatest(count(*) FILTER ((b - 128) / 40.0 > -1), 1), 6) AS stability
FROM mask_px m JOIN px p ON p.scene_id = m.scene_id AND p."row" = m."row" AND p.col = m.col GROUP BY ALL"""
)
def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.px(spark, sf_dir).select("scene_id", "row", "col", ((F.col("b") - 128) / 40.0).alias("logit"))
    return rounded(scenery.stability_score(masks(spark, sf_dir).join(px, ["scene_id", "row", "col"]), "logit"))


@registry.add(
    MASK_SQL
    + """, oa AS (SELECT x.scene_id, x.mask_id, x."row", x.col FROM mask_px x JOIN mask_px t ON t.mask_id = x.mask_id AND abs(t."row" - x."row") <= 1 AND abs(t.col - x.col) <= 1 GROUP BY ALL HAVING count(*) < 9),
ob AS (SELECT scene_id, mask_id, "row" + mask_id % 4 AS "row", col FROM oa),
p AS (SELECT scene_id, mask_id, avg(CAST(hit AS INTEGER)) AS p FROM (SELECT a.scene_id, a.mask_id, a."row", a.col, bool_or(pow(a."row" - b."row", 2) + pow(a.col - b.col, 2) <= 4) AS hit FROM oa a JOIN ob b ON b.mask_id = a.mask_id GROUP BY ALL) GROUP BY ALL),
r AS (SELECT scene_id, mask_id, avg(CAST(hit AS INTEGER)) AS r FROM (SELECT b.scene_id, b.mask_id, b."row", b.col, bool_or(pow(a."row" - b."row", 2) + pow(a.col - b.col, 2) <= 4) AS hit FROM ob b JOIN oa a ON b.mask_id = a.mask_id GROUP BY ALL) GROUP BY ALL)
SELECT scene_id, mask_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS boundary_f1 FROM p JOIN r USING (scene_id, mask_id)"""
)
def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask against itself, moved by up to three rows."""
    own = masks(spark, sf_dir)
    return rounded(scenery.boundary_f1(own, own.withColumn("row", (F.col("row") + F.col("mask_id") % 4).cast("int"))))


_GROUP = "CASE WHEN mask_id % 6 = 1 THEN mask_id - 1 WHEN mask_id % 6 = 3 AND col % 2 = 0 THEN -mask_id ELSE mask_id END"


@registry.add(
    MASK_SQL
    + f""", v AS (SELECT scene_id, mask_id, "row", col, mask_id * 4096 + "row" * {N} + col AS vid, min(mask_id * 4096 + "row" * {N} + col) OVER (PARTITION BY mask_id) AS label FROM mask_px),
q AS (SELECT a.scene_id, a.vid AS nw, {_GROUP.replace("mask_id", "a.mask_id").replace("col", "a.col")} AS grp FROM v a JOIN v b ON b.mask_id = a.mask_id AND b."row" = a."row" + 1 AND b.col = a.col + 1),
u AS (SELECT DISTINCT scene_id, grp, unnest([nw, nw + 1, nw + {N}, nw + {N + 1}]) AS vid FROM q), z AS (SELECT scene_id, label, count(*) AS size FROM v GROUP BY ALL),
k AS (SELECT u.scene_id, grp, count(*) AS n, min(label) AS label, max(label) AS most FROM u JOIN v ON v.scene_id = u.scene_id AND v.vid = u.vid GROUP BY ALL),
w AS (SELECT scene_id, sum(n - 1) AS shared FROM (SELECT scene_id, vid, count(*) AS n FROM u GROUP BY ALL) GROUP BY ALL),
o AS (SELECT k.scene_id, count(*) AS buildings, avg(CAST(k.label = most AND n = size AS INTEGER)) AS own FROM k JOIN z ON z.scene_id = k.scene_id AND z.label = k.label GROUP BY ALL)
SELECT scene_id, buildings, round(own, 6) AS own_component, CAST(shared AS BIGINT) AS shared_vertices, round(own * CASE WHEN shared = 0 THEN 1 ELSE 0.5 END, 6) AS separation_score FROM o JOIN w USING (scene_id)"""
)
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh for each mask; every sixth shares its group with the one before, every sixth is split into two that share vertices."""
    own = masks(spark, sf_dir)
    vid = F.col("mask_id").cast("long") * 4096 + F.col("row") * N + F.col("col")
    v = own.select("scene_id", vid.alias("vid"))
    face = lambda *ids: F.struct(*(i.alias(c) for i, c in zip(ids, "abc", strict=True)))
    cells = footprints.to_cells(own).select("scene_id", F.expr(_GROUP).cast("long").alias("grp"), vid.alias("nw"))
    nw = F.col("nw")
    f = cells.select("scene_id", "grp", F.explode(F.array(face(nw, nw + N, nw + 1), face(nw + 1, nw + N, nw + N + 1))).alias("f")).select("scene_id", "grp", "f.*")
    return rounded(scenery.separation(v, f, mesh.mesh_components(f, 1 << 40)))


_FINE_SQL = f"""WITH b AS ({focal_registry.sql["block_error"]}), f AS (SELECT *, error > 75 AS fine FROM b),
k AS (SELECT *, br * 8 AS r0, bc * 8 AS c0, least(br * 8 + 8, {N - 1}) AS r1, least(bc * 8 + 8, {N - 1}) AS c1, coalesce(lag(fine) OVER d, false) AS up, coalesce(lead(fine) OVER d, false) AS down,
  coalesce(lag(fine) OVER a, false) AS lef, coalesce(lead(fine) OVER a, false) AS rig FROM f WINDOW d AS (PARTITION BY scene_id, bc ORDER BY br), a AS (PARTITION BY scene_id, br ORDER BY bc))
"""


@registry.add(
    _FINE_SQL
    + f"""SELECT DISTINCT scene_id, CAST(y.range AS INTEGER) AS "row", CAST(x.range AS INTEGER) AS col FROM k, range({N}) y, range({N}) x WHERE y.range BETWEEN r0 AND r1 AND x.range BETWEEN c0 AND c1 AND
(fine OR (y.range IN (r0, r1) AND x.range IN (c0, c1)) OR (y.range = (r0 + r1) // 2 AND x.range = (c0 + c1) // 2) OR (up AND y.range = r0) OR (down AND y.range = r1) OR (lef AND x.range = c0) OR (rig AND x.range = c1))"""
)
def adaptive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of a mesh whose blocks are fine where the surface through their corners misses by over 75 m."""
    return scenery.adaptive_vertices(scenery.adaptive_blocks(views.surface(spark, sf_dir), "z", N, N, 75.0), N, N)


@registry.add(
    M_SQL
    + """, i AS (SELECT DISTINCT CAST(o_orderkey // 1024 AS INTEGER) AS scene_id FROM orders), t AS (SELECT scene_id, sum(h_pred * h_ref) / sum(h_pred * h_pred) AS target, count(*) AS n_px FROM m GROUP BY ALL),
j AS (SELECT *, CASE WHEN scene_id % 5 = 1 THEN 'no relative depth' WHEN scene_id % 7 = 2 THEN 'no reference' WHEN scene_id % 2 = 1 AND scene_id % 3 = 0 THEN 'elevation without bare earth'
  WHEN scene_id % 11 = 4 THEN 'grid mismatch' WHEN target IS NULL THEN 'empty high band' END AS reason FROM i LEFT JOIN t USING (scene_id))
SELECT j.scene_id, reason, round(target, 6) AS target, n_px, round(avg(abs(greatest(target * h_pred, 0) - h_ref)), 6) AS ndsm_mae_at_target, round(avg(abs(h_ref)), 6) AS floor_mae
FROM j JOIN m USING (scene_id) WHERE reason IS NULL GROUP BY ALL UNION ALL SELECT scene_id, reason, NULL, NULL, NULL, NULL FROM j WHERE reason IS NOT NULL"""
)
def collect_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all scenes, and the scenes that give none, with the reason."""
    k = F.col("scene_id")
    found = lambda missing, path: F.when(~missing, F.concat(F.lit(path), k.cast("string")))
    inventory = views.read(spark, sf_dir, "orders").select(views.scene_of("o_orderkey", views.ORDERS_A_SCENE)).distinct().select(
        "scene_id", found(k % 5 == 1, "depth/").alias("depth"), found(k % 7 == 2, "reference/").alias("reference"), F.when(k % 2 == 1, "dsm").otherwise("ndsm").alias("reference_kind"),
        found(k % 3 == 0, "dtm/").alias("dtm"), F.lit(N).alias("depth_size"), F.when(k % 11 == 4, N // 2).otherwise(N).alias("truth_size"),
    )
    samples, skipped = scenery.collect_samples(inventory, metres(spark, sf_dir), "h_pred", "h_ref")
    return rounded(samples.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped, allowMissingColumns=True))


@registry.add()
def select_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings among the painted masks, each level and seven metres or more above a ground of little relief; tests hold the operator against a fixture."""
    painted = instances.paint_instances(masks(spark, sf_dir), 12)[1]
    px = views.full_grid(spark, sf_dir).join(painted, ["scene_id", "row", "col"], "left")
    up = F.col("col") % 4 / 10 + F.when(F.col("instance").isNotNull(), 8 + F.col("instance") % 7).otherwise(1.0)
    own = px.select("scene_id", "row", "col", F.when(F.col("instance") % 9 == 4, 3).otherwise(2).alias("sem"), up.alias("up"))
    return rounded(scenery.select_buildings(painted, own, "up", N, N))
