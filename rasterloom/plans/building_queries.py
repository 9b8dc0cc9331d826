"""Queries of mosaics, outlines, solids and where facades take their colour from."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import adaptive, calibration, focal, footprints, mesh, mosaic, outlines, proposals, regular, runs, scenery, solids
from rasterloom.plans.calibration_queries import graph_anchors
from rasterloom.plans.focal_queries import S_SQL
from rasterloom.plans.mesh_queries import MASK_SQL, masks
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.scenery_queries import _FINE_SQL
from rasterloom.plans.score_queries import metres
from rasterloom.session import shared_folder
from rasterloom.sources import views

registry = Registry()
N = views.GRID
CHIP, OVERLAP, RAMP = 24, 0.25, 3


@registry.add(S_SQL + """SELECT scene_id, "row", col, round((z - min(z) OVER s) / (max(z) OVER s - min(z) OVER s), 6) AS relative FROM surface WINDOW s AS (PARTITION BY scene_id)""")
def blend_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chip sees the surface through a line of its own; the mosaic gives the surface back."""
    chips = mosaic.chip_windows(views.surface(spark, sf_dir), N, N, CHIP, OVERLAP)
    slope = 0.5 + (F.col("r") * 7 + F.col("c") * 3 + F.col("scene_id")) % 5 * 0.25
    own = chips.withColumn("depth", slope * F.col("z") / 100 + (F.col("r") + F.col("c") * 2) % 7 * 0.1)
    return rounded(mosaic.blend_mosaic(own, "depth", CHIP, RAMP))


def brightness(chips: np.ndarray) -> np.ndarray:
    """A predictor of chips that needs no model: taller where brighter."""
    return chips.astype(float).sum(-1)


@registry.add()
def predict_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor over overlapping chips, three at a time; tests hold chips and batches against brute force."""
    return mosaic.predict_mosaic(views.px(spark, sf_dir), ("r", "g", "b"), N, N, brightness, CHIP, OVERLAP, 3)


PUNCHED = "(row * 7 + col * 5 + mask_id) % 11 <> 0"
PUNCH_SQL = MASK_SQL + """, own AS (SELECT * FROM mask_px WHERE ("row" * 7 + col * 5 + mask_id) % 11 <> 0)"""


def punched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks with holes, notches and pinches."""
    return masks(spark, sf_dir).filter(PUNCHED)


@registry.add(
    PUNCH_SQL
    + """, n AS (SELECT scene_id, mask_id, count(*) AS area FROM own GROUP BY ALL),
s AS (SELECT scene_id, mask_id, k, y, x FROM (SELECT scene_id, mask_id, unnest([0, 0, 1, 1]) AS k, unnest(["row", "row" + 1, "row", "row"]) AS y, unnest([col, col, col, col + 1]) AS x FROM own) GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT scene_id, mask_id, count(*) AS n_edges FROM s GROUP BY ALL),
q AS (SELECT scene_id, mask_id, y, x, sum(b) AS bits, count(*) AS k FROM (SELECT scene_id, mask_id, unnest([8, 4, 2, 1]) AS b, unnest(["row", "row", "row" + 1, "row" + 1]) AS y, unnest([col, col + 1, col, col + 1]) AS x FROM own) GROUP BY ALL),
e AS (SELECT scene_id, mask_id, (count(*) FILTER (k = 1) - count(*) FILTER (k = 3) + 2 * count(*) FILTER (bits IN (6, 9))) // 4 AS euler FROM q GROUP BY ALL)
SELECT scene_id, mask_id, CAST(area AS DOUBLE) AS area, n_edges, euler FROM n JOIN p USING (scene_id, mask_id) JOIN e USING (scene_id, mask_id)"""
)
def trace_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mask: the signed areas of its rings (its pixels), their edges, and outer rings less holes."""
    rings = outlines.trace_outlines(punched(spark, sf_dir), N + 1)
    sign = F.when(F.col("area") > 0, 1).otherwise(-1)
    return rings.groupBy("scene_id", "mask_id").agg(F.sum("area").alias("area"), F.sum("n_edges").alias("n_edges"), F.sum(sign).alias("euler"))


@registry.add(
    MASK_SQL
    + """, b AS (SELECT scene_id, mask_id, max("row") - min("row") + 1 AS sy, max(col) - min(col) + 1 AS sx FROM mask_px GROUP BY ALL)
SELECT scene_id, mask_id, CAST(2 * (sy + sx) AS BIGINT) AS n_edges, CAST(sy * sx AS DOUBLE) AS area, 4 AS n_corners FROM b"""
)
def longest_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = outlines.longest_outline(outlines.trace_outlines(masks(spark, sf_dir), N + 1))
    return rings.select("scene_id", "mask_id", "n_edges", "area", F.size("pts").alias("n_corners"))


def _passes(first: str, n: int) -> str:
    """SQL of ``n`` passes that remove pinches from the cells ``first``."""
    out = ""
    for k in range(n):
        now = first if k == 0 else f"u{k}"
        out += f""", w{k} AS (SELECT scene_id, mask_id, y, x, sum(b) AS bits FROM (SELECT scene_id, mask_id, unnest([8, 4, 2, 1]) AS b, unnest(["row", "row", "row" + 1, "row" + 1]) AS y, unnest([col, col + 1, col, col + 1]) AS x FROM {now}) GROUP BY ALL),
u{k + 1} AS (SELECT * FROM {now} c WHERE NOT EXISTS (SELECT 1 FROM w{k} w WHERE w.scene_id = c.scene_id AND w.mask_id = c.mask_id AND w.y = c."row" AND ((w.bits = 9 AND w.x = c.col) OR (w.bits = 6 AND w.x = c.col + 1))))"""
    return out


#: Cells of punched masks with a pinch here and there: a cell stays where another rule leaves it.
CELL_SQL = MASK_SQL + """, own AS (SELECT scene_id, mask_id, "row", col FROM mask_px WHERE ("row" * 5 + col * 3 + mask_id) % 7 < 5)""" + _passes("own", 4)


def pinched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each mask, of which two of seven are out, so that many meet at corners alone."""
    return masks(spark, sf_dir).filter("(row * 5 + col * 3 + mask_id) % 7 < 5")


@registry.add(CELL_SQL + """SELECT scene_id, mask_id, "row", col FROM u4""")
def unpinch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solids.unpinch(pinched_cells(spark, sf_dir))


SOLID_SQL = CELL_SQL + f""", cell AS (SELECT * FROM u4), roof AS (SELECT scene_id, "row", col, z + 5 AS z FROM surface),
spot AS (SELECT DISTINCT scene_id, mask_id, y, x FROM (SELECT scene_id, mask_id, unnest(["row", "row", "row" + 1, "row" + 1]) AS y, unnest([col, col + 1, col, col + 1]) AS x FROM cell)),
side AS (SELECT scene_id, mask_id, way, y, x, any_value(y1) AS y1, any_value(x1) AS x1 FROM (SELECT scene_id, mask_id, unnest([0, 0, 1, 1]) AS way, unnest(["row", "row" + 1, "row", "row"]) AS y, unnest([col, col, col, col + 1]) AS x,
  unnest(["row", "row" + 1, "row" + 1, "row" + 1]) AS y1, unnest([col + 1, col + 1, col, col + 1]) AS x1 FROM cell) GROUP BY ALL HAVING count(*) = 1),
foot AS (SELECT DISTINCT scene_id, mask_id, y, x FROM (SELECT scene_id, mask_id, unnest([y, y1]) AS y, unnest([x, x1]) AS x FROM side)),
feet AS (SELECT scene_id, mask_id, count(*) AS n_feet FROM foot GROUP BY ALL)
"""


def city(spark: SparkSession, sf_dir: str, floor: bool = False) -> tuple[DataFrame, DataFrame]:
    """Solids over unpinched cells, five metres and the surface high, on ground 0."""
    there = views.full_grid(spark, sf_dir, 1).select("scene_id")
    cells = solids.unpinch(pinched_cells(spark, sf_dir).filter(f"row < {N - 1} and col < {N - 1}").join(there, "scene_id", "left_semi"))
    roof = solids.heights_at_corners(cells, views.surface(spark, sf_dir).withColumn("z", F.col("z") + 5), "z")
    ground = cells.select("scene_id", "mask_id").distinct().withColumn("ground_m", F.lit(0.0))
    return solids.building_solids(cells, roof, ground, N, N, 0.5, floor=floor)


SOLID_SQL = SOLID_SQL.replace('WHERE ("row" * 5 + col * 3 + mask_id) % 7 < 5', f'WHERE ("row" * 5 + col * 3 + mask_id) % 7 < 5 AND "row" < {N - 1} AND col < {N - 1} AND scene_id IN (SELECT scene_id FROM px_full)')


@registry.add(
    SOLID_SQL
    + """, a AS (SELECT scene_id, mask_id, count(*) AS n_cells FROM cell GROUP BY ALL), b AS (SELECT scene_id, mask_id, count(*) AS n_roof FROM spot GROUP BY ALL),
w AS (SELECT s.scene_id, s.mask_id, count(*) AS n_sides, sum(0.25 * (p.z + q.z)) AS wall_area FROM side s JOIN roof p ON p.scene_id = s.scene_id AND p."row" = s.y AND p.col = s.x JOIN roof q ON q.scene_id = s.scene_id AND q."row" = s.y1 AND q.col = s.x1 GROUP BY ALL)
SELECT scene_id, mask_id, n_roof + n_feet AS n_vertices, 2 * n_cells AS roof_faces, 2 * n_sides AS wall_faces, round(wall_area, 6) AS wall_area FROM a JOIN b USING (scene_id, mask_id) JOIN w USING (scene_id, mask_id) JOIN feet USING (scene_id, mask_id)"""
)
def building_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per building: vertices, faces by kind and the area of its walls."""
    v, f = city(spark, sf_dir)
    keys = ["scene_id", "mask_id"]
    # Only walls are measured, so only they meet their vertices.
    walls = mesh.face_normals(v, f.filter("part = 'wall'"), ("mask_id",)).groupBy(*keys).agg(F.count("*").alias("wall_faces"), F.sum("area").alias("wall_area"))
    roofs = f.filter("part = 'roof'").groupBy(*keys).agg(F.count("*").alias("roof_faces"))
    faces = roofs.join(walls, keys)
    return rounded(v.groupBy(*keys).agg(F.count("*").alias("n_vertices")).join(faces, keys))


@registry.add(
    SOLID_SQL
    + f""", cnt AS (SELECT scene_id, count(*) AS n_faces FROM (SELECT scene_id FROM cell UNION ALL SELECT scene_id FROM cell UNION ALL SELECT scene_id FROM cell UNION ALL SELECT scene_id FROM cell UNION ALL SELECT scene_id FROM side UNION ALL SELECT scene_id FROM side) GROUP BY ALL),
vtx AS (SELECT scene_id, mask_id, y, x, 0 AS low FROM spot UNION ALL SELECT scene_id, mask_id, y, x, 1 FROM spot),
vn AS (SELECT scene_id, count(*) AS n_vertices, max(vid) - min(vid) + 1 AS span FROM (SELECT scene_id, row_number() OVER (PARTITION BY scene_id) AS vid FROM vtx) GROUP BY ALL)
SELECT scene_id, n_vertices, span, n_faces, 0 AS n_degenerate, 0 AS n_unreferenced, 0 AS n_boundary, 0 AS n_nonmanifold FROM cnt JOIN vn USING (scene_id)"""
)
def solid_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed solids have no open edge and none of three faces or more, and their vertices are numbered without gaps."""
    v, f = city(spark, sf_dir, floor=True)
    own = v.select("scene_id", "vid", "x", "y", "z")
    span = own.groupBy("scene_id").agg((F.max("vid") - F.min("vid") + 1).alias("span"))
    return mesh.validate_mesh(own, f, linked=False).drop("z_min", "z_max").join(span, "scene_id")


FACADE_SQL = MASK_SQL + """, fl AS (SELECT m.scene_id, m.mask_id, m."row" AS y, m.col AS x, coalesce(p.sem IN (1, 3), false) AS k, coalesce(p.g < 20, false) AS d FROM mask_px m LEFT JOIN px p ON p.scene_id = m.scene_id AND p."row" = m."row" AND p.col = m.col),
kd AS (SELECT scene_id, mask_id, bool_or(k) AS ks, bool_or(d) AS ds, bool_or(NOT k AND NOT d) AS fine FROM fl GROUP BY ALL),
ad AS (SELECT fl.* FROM fl JOIN kd USING (scene_id, mask_id) WHERE NOT fine OR (NOT k AND NOT d)),
o AS (SELECT y.range AS dy, x.range AS dx, y.range * y.range + x.range * x.range AS d2 FROM range(-12, 13) y, range(-12, 13) x WHERE y.range <> 0 OR x.range <> 0),
ds AS (SELECT a.scene_id, a.mask_id, a.y, a.x, min(d2) AS d2 FROM ad a, o WHERE a.y + dy BETWEEN 0 AND 63 AND a.x + dx BETWEEN 0 AND 63 AND NOT EXISTS (SELECT 1 FROM ad b WHERE b.scene_id = a.scene_id AND b.mask_id = a.mask_id AND b.y = a.y + dy AND b.x = a.x + dx) GROUP BY ALL),
fs AS (SELECT scene_id, mask_id, arg_min(y, (-d2, y, x)) AS "row", arg_min(x, (-d2, y, x)) AS col, sqrt(max(d2)) AS depth FROM ds GROUP BY ALL),
sample AS (SELECT scene_id, mask_id, fs."row", fs.col, round(depth, 6) AS depth, CASE WHEN NOT fine THEN 'no admissible interior pixel - the whole footprint reads as ' || nm WHEN ks OR ds THEN 'deepest interior pixel, after excluding ' || nm ELSE 'deepest interior pixel' END AS reason
  FROM fs JOIN (SELECT *, concat_ws(' and ', CASE WHEN ks THEN 'semantic road/vegetation/water' END, CASE WHEN ds THEN 'the OSM road network' END) AS nm FROM kd) USING (scene_id, mask_id))
"""


def facade_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.px(spark, sf_dir).select("scene_id", "row", "col", F.col("sem").isin(1, 3).alias("by_class"), (F.col("g") < 20).alias("by_road"))


@registry.add(FACADE_SQL + """SELECT scene_id, mask_id, "row", col, depth, reason FROM sample""")
def facade_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(solids.facade_sample(masks(spark, sf_dir), facade_flags(spark, sf_dir), N, N))


@registry.add(
    SOLID_SQL
    + FACADE_SQL[len(MASK_SQL) :]
    + """, rd AS (SELECT scene_id, "row", col FROM px WHERE g < 20),
z AS (SELECT f.scene_id, f.mask_id, s."row", s.col FROM foot f JOIN sample s USING (scene_id, mask_id))
SELECT z.scene_id, count(*) AS wall_vertices, round(count(rd."row") / count(*), 6) AS sampling_road, round(count(m."row") / count(*), 6) AS sampling_own_footprint FROM z
LEFT JOIN rd ON rd.scene_id = z.scene_id AND rd."row" = z."row" AND rd.col = z.col LEFT JOIN mask_px m ON m.scene_id = z.scene_id AND m.mask_id = z.mask_id AND m."row" = z."row" AND m.col = z.col GROUP BY ALL"""
)
def uv_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the feet of all walls take their colour from, after ``facade_uv``."""
    own, px = masks(spark, sf_dir), views.px(spark, sf_dir)
    v, _ = city(spark, sf_dir)
    uv = solids.facade_uv(v, solids.facade_sample(own, facade_flags(spark, sf_dir), N, N), N, N, 0.5)
    return rounded(solids.uv_audit(uv, px.filter("g < 20"), own, N, N))


@registry.add(
    SOLID_SQL
    + """, mid AS (SELECT scene_id, mask_id, avg(y) AS mr, avg(x) AS mc, count(*) AS n FROM spot GROUP BY ALL),
r AS (SELECT s.*, mr, mc, n, sqrt((y - mr) * (y - mr) + (x - mc) * (x - mc)) AS far FROM spot s JOIN mid USING (scene_id, mask_id))
SELECT scene_id, mask_id, y AS "row", x AS col, round(x - (x - mc) * k + 1e-9, 6) AS uv_col, round(y - (y - mr) * k + 1e-9, 6) AS uv_row FROM (SELECT *, CASE WHEN n > 2 AND far > 1e-6 THEN least(2.4, far * 0.45) / far ELSE 0 END AS k FROM r)"""
)
def facade_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the roofs of all solids take their colour from, 1.2 m inside their rim."""
    v, _ = city(spark, sf_dir)
    uv = solids.facade_uv(v, v.select("scene_id", "mask_id", "row", "col").limit(0), N, N, 0.5)
    # A bit more than each value, so that no tie of rounding falls on one of them.
    return rounded(uv.filter("part = 'roof'").select("scene_id", "mask_id", "row", "col", *((F.col(c) + 1e-9).alias(c) for c in ("uv_row", "uv_col"))))


FAN_SQL = (
    _FINE_SQL
    + f""", own AS (SELECT *, ((r0 + r1) // 2) * {N} + (c0 + c1) // 2 AS centre FROM k),
live AS (SELECT DISTINCT scene_id, y.range AS y, x.range AS x FROM own, range({N}) y, range({N}) x WHERE y.range BETWEEN r0 AND r1 AND x.range BETWEEN c0 AND c1 AND
(fine OR (y.range IN (r0, r1) AND x.range IN (c0, c1)) OR (y.range = (r0 + r1) // 2 AND x.range = (c0 + c1) // 2) OR (up AND y.range = r0) OR (down AND y.range = r1) OR (lef AND x.range = c0) OR (rig AND x.range = c1))),
ring AS (SELECT o.scene_id, br, bc, centre, l.y * {N} + l.x AS a, CASE WHEN l.y = r1 AND l.x < c1 THEN l.x - c0 WHEN l.x = c1 AND l.y > r0 THEN c1 - c0 + r1 - l.y WHEN l.y = r0 AND l.x > c0 THEN c1 - c0 + r1 - r0 + c1 - l.x ELSE 2 * (c1 - c0) + r1 - r0 + l.y - r0 END AS k
  FROM own o JOIN live l ON l.scene_id = o.scene_id AND l.y BETWEEN r0 AND r1 AND l.x BETWEEN c0 AND c1 WHERE NOT fine AND (l.y IN (r0, r1) OR l.x IN (c0, c1))),
fan AS (SELECT scene_id, a, coalesce(lead(a) OVER b, first(a) OVER b) AS b, centre AS c FROM ring WINDOW b AS (PARTITION BY scene_id, br, bc ORDER BY k)),
cell AS (SELECT scene_id, y.range * {N} + x.range AS tl FROM own, range({N}) y, range({N}) x WHERE fine AND y.range BETWEEN r0 AND r1 - 1 AND x.range BETWEEN c0 AND c1 - 1)
"""
)


@registry.add(FAN_SQL + f"SELECT scene_id, tl + {N} AS a, tl + {N + 1} AS b, tl + 1 AS c FROM cell UNION ALL SELECT scene_id, tl + {N}, tl + 1, tl FROM cell UNION ALL SELECT scene_id, a, b, c FROM fan WHERE a <> c AND b <> c")
def adaptive_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the vertices of ``adaptive_plan``."""
    blocks = scenery.adaptive_blocks(views.surface(spark, sf_dir), "z", N, N, 75.0)
    return adaptive.adaptive_triangles(blocks, scenery.adaptive_vertices(blocks, N, N), N, N)


@registry.add()
def tolerance_for_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tightest tolerance whose mesh of each scene, a gentler surface, has at most 5 000 triangles; tests hold it against counts of triangles."""
    px = views.surface(spark, sf_dir).withColumn("z", F.col("z") / 20 * (F.col("col") % 8) / 8)
    return rounded(adaptive.tolerance_for_budget(px, "z", N, N, 5000))


@registry.add()
def bootstrap_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of every pixel over 24 fits; tests hold them against fits done one by one."""
    px = metres(spark, sf_dir).select("scene_id", "row", "col", (F.col("pred") / 1000).alias("d"))
    return rounded(calibration.bootstrap_sigma(px, graph_anchors(spark, sf_dir), N, N, 32), 3)


def study_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of each scene with depth, class, a smooth elevation model, and reference: hills, boxes of buildings, and depth that bends across the scene."""
    hill = 200 + F.col("scene_id") % 9 + 0.3 * F.col("row") + 6 * F.sin(F.col("col") / 9)
    px = views.px_full(spark, sf_dir).select("scene_id", "row", "col", F.coalesce("sem", F.lit(0)).alias("cls"))
    tall = (F.expr("row div 12 + col div 12") % 3 == 0) & (F.col("row") % 12 < 7) & (F.col("col") % 12 < 7)
    own = px.withColumns({"dem": hill, "ref": hill + F.when(tall, 12.0).otherwise(0.0), "sem": F.when(tall, 2).when(F.col("cls") == 2, 0).otherwise(F.col("cls"))})
    return own.withColumn("d", (F.col("ref") - 180) / (60 + F.col("col") / 8)).select("scene_id", "row", "col", "d", "sem", "dem", "ref")


@registry.add()
def run_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenes calibrated and scored; every seventh lacks its image, every eleventh its depth. Tests hold the operator against a study of ten scenes."""
    k = F.col("scene_id")
    px = study_px(spark, sf_dir).withColumn("d", F.when(k % 11 != 5, F.col("d")))
    ids = views.full_grid(spark, sf_dir, 1).select("scene_id")
    inventory = ids.select("scene_id", F.when(k % 7 != 3, F.concat(F.lit("image/"), k)).alias("image"), F.concat(F.lit("reference/"), k).alias("reference"))
    scenes = ids.select("scene_id", F.lit(True).alias("georeferenced"), F.lit("copernicus_30.tif").alias("dem_source"))
    records, _ = runs.run_study(inventory, px, scenes, N, N, 2.0, replicates=4, anchor_stride=8, smooth=12.0)
    return rounded(records.select("scene_id", "reason", "tier", "n_used", "n_px", "mae_m", "rmse_m", "bias_m"), 3)


_TILES = [(k, y, x) for k, n in ((0, 64), (1, 32), (2, 16)) for y in range(0, n, 24) for x in range(0, n, 24)]
_TILE_BYTES = sum(3 * (min(24, (64 >> k) - y) + 2) * (min(24, (64 >> k) - x) + 2) for k, y, x in _TILES)


@registry.add(
    S_SQL
    + f""", l AS (SELECT scene_id, 'z' AS layer, z AS v FROM surface UNION ALL SELECT scene_id, 'up', z * 2 + "row" FROM surface)
SELECT scene_id, layer, CAST({_TILE_BYTES} AS BIGINT) AS bytes, CAST({len(_TILES)} AS BIGINT) AS n_tiles, CAST({64 * 64 + 32 * 32 + 16 * 16} AS BIGINT) AS n_px, round(min(v), 6) AS lo, round(max(v), 6) AS hi, true AS within FROM l GROUP BY ALL"""
)
def build_tileset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of two layers, written, read back and held against the pixels they came from."""
    px = views.surface(spark, sf_dir).withColumn("up", F.col("z") * 2 + F.col("row"))
    path = f"{shared_folder(spark)}/tileset-{uuid.uuid4().hex}"
    manifest = runs.build_tileset(px, ["z", "up"], path, N, N, 24, 1, 3)
    long = focal.pyramid(px, 3, N, N).unpivot(["scene_id", "lod", "row", "col"], ["z", "up"], "layer", "was")
    met = runs.decode_tiles(runs.read_tiles(spark, path)).join(long, ["scene_id", "layer", "lod", "row", "col"], "full")
    kept = met.groupBy("scene_id", "layer").agg(F.count("*").alias("n_px"), F.max(F.coalesce(F.abs(F.col("v") - F.col("was")), F.lit(1.0))).alias("off"))
    tiles = F.aggregate("lods", F.lit(0).cast("long"), lambda n, x: n + F.size(x["tiles"]))
    out = manifest.join(kept, ["scene_id", "layer"])
    return rounded(out.select("scene_id", "layer", "bytes", tiles.alias("n_tiles"), "n_px", "lo", "hi", (F.col("off") <= (F.col("hi") - F.col("lo")) / 2**25 + 1e-9).alias("within")))


@registry.add()
def delivery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload, bit depths and round trips of one layer in one table; its parts have twins of their own."""
    px = views.surface(spark, sf_dir)
    path = f"{shared_folder(spark)}/tileset-{uuid.uuid4().hex}"
    runs.build_tileset(px, ["z"], path, N, N, 24, 1, 2)
    return rounded(runs.delivery_report(px, ["z"], runs.read_tiles(spark, path), N, N, 2, (16, 8)))


@registry.add()
def regular_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of all masks with notches, squared up where that holds; tests hold the operator against turned rectangles, an L and a circle."""
    out = regular.regular_outlines(punched(spark, sf_dir), N, N, 0.5)
    return rounded(out.select("scene_id", "mask_id", "stage", "vertices_in", "vertices_out", "area_change", "max_shift_m", "angle_deg", F.array_join("refused", "; ").alias("refused")), 4)


def levels():
    """Loaded once a worker: the pixels of a chip over each of four levels, as sure as the level is high."""

    def find(image: np.ndarray) -> list[tuple[np.ndarray, float, float]]:
        r = image[..., 0].astype(int)
        return [(r >= t, t / 256, float((r >= t + 8).sum()) / max(float((r >= t - 8).sum()), 1.0)) for t in (100, 144, 160, 200)]

    return find


@registry.add(
    S_SQL
    + """, t AS (SELECT unnest([100, 144, 160, 200]) AS t),
p AS (SELECT scene_id, "row" // 32 * 32 AS y, col // 32 * 32 AS x, t, count(*) FILTER (r >= t) AS area_px, count(*) FILTER (r >= t + 8) / greatest(count(*) FILTER (r >= t - 8), 1) AS stability,
  min("row") FILTER (r >= t) AS y0, min(col) FILTER (r >= t) AS x0, max("row") FILTER (r >= t) AS y1, max(col) FILTER (r >= t) AS x1 FROM px, t GROUP BY ALL)
SELECT scene_id, CAST(y AS INTEGER) AS chip_row, CAST(x AS INTEGER) AS chip_col, t / 256 AS iou, round(stability, 6) AS stability, CAST(area_px AS INTEGER) AS area_px, area_px AS n_px, y0, x0, y1, x1 FROM p WHERE t / 256 >= 0.55 AND stability >= 0.75 AND area_px >= 64"""
)
def mask_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of every chip of 32 pixels that pass the thresholds, with the pixels counted from the second table."""
    records, found = proposals.mask_source(views.px(spark, sf_dir), ("r",), N, N, levels, 32, 0.0)
    n = found.groupBy("scene_id", "mask_id").agg(F.count("*").alias("n_px"))
    out = records.join(n, ["scene_id", "mask_id"])
    return rounded(out.select("scene_id", F.col("r").alias("chip_row"), F.col("c").alias("chip_col"), "iou", "stability", "area_px", "n_px", "y0", "x0", "y1", "x1"))


def _plane_sql(t: str) -> str:
    """SQL of the least-squares plane of each group of ``t`` (scene_id, mask_id, x, y, z); zero slopes' place is null for points on a line."""
    return f"""SELECT scene_id, mask_id, a, b, mz - a * mx - b * my AS c FROM (SELECT *, (xz * yy - yz * xy) / d AS a, (yz * xx - xz * xy) / d AS b FROM (SELECT *, CASE WHEN abs(xx * yy - xy * xy) * n * n > 1e-9 THEN xx * yy - xy * xy END AS d FROM (
  SELECT scene_id, mask_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM {t} GROUP BY ALL)))"""


@registry.add(
    MASK_SQL
    + f""", k AS (SELECT b.scene_id, mask_id, ref_mm / 1000.0 + 0.0 AS z, b."row" AS y, b.col AS x FROM mask_px b JOIN px p ON p.scene_id = b.scene_id AND p."row" = b."row" AND p.col = b.col), n AS (SELECT scene_id, mask_id, count(*) AS n FROM k GROUP BY ALL),
e AS (SELECT k.* FROM k JOIN n USING (scene_id, mask_id) WHERE n >= 8), f AS ({_plane_sql("e")}), r AS (SELECT e.*, z - a * x - b * y - c AS r FROM e JOIN f USING (scene_id, mask_id)),
m AS (SELECT scene_id, mask_id, median(r) AS m FROM r GROUP BY ALL), d AS (SELECT scene_id, mask_id, median(abs(r - m)) AS mad FROM r JOIN m USING (scene_id, mask_id) GROUP BY ALL),
j AS (SELECT r.*, abs(r) <= greatest(6000, 3 * mad) AS k FROM r JOIN d USING (scene_id, mask_id)), w AS (SELECT scene_id, mask_id FROM j GROUP BY ALL HAVING count(*) FILTER (k) >= 8 AND count(*) FILTER (k) < count(*)),
g AS (SELECT j.scene_id, j.mask_id, x, y, z FROM j JOIN w USING (scene_id, mask_id) WHERE k), h AS ({_plane_sql("g")}),
l AS (SELECT f.scene_id, f.mask_id, coalesce(h.a, f.a) AS a, coalesce(h.b, f.b) AS b, coalesce(h.c, f.c) AS c FROM f LEFT JOIN h ON h.scene_id = f.scene_id AND h.mask_id = f.mask_id),
o AS (SELECT scene_id, mask_id, a, b, c, avg(CAST(abs(z - a * x - b * y - c) <= 6000 AS INTEGER)) AS inlier, sqrt(avg((z - a * x - b * y - c) ** 2)) AS rmse FROM e JOIN l USING (scene_id, mask_id) GROUP BY ALL)
SELECT scene_id, mask_id, n, round(a + 1e-7, 4) AS a, round(b + 1e-7, 4) AS b, round(c + 1e-7, 3) AS c, round(coalesce(inlier, 0), 6) AS inlier, round(rmse, 3) AS rmse FROM n LEFT JOIN o USING (scene_id, mask_id)"""
)
def refit_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of all masks, fitted twice; the surface is rough, so the tolerance is 6 000 m. A bit more than each is told, so that no tie of rounding falls on one."""
    own = masks(spark, sf_dir).join(metres(spark, sf_dir).select("scene_id", "row", "col", F.col("ref").alias("z")), ["scene_id", "row", "col"])
    out = footprints.refit_plane(own, tolerance=6000.0)
    return out.select("scene_id", "mask_id", "n", *((F.round(F.col(c) + more, d) + 0.0).alias(c) for c, d, more in (("a", 4, 1e-7), ("b", 4, 1e-7), ("c", 3, 1e-7), ("inlier", 6, 0.0), ("rmse", 3, 0.0))))
