"""Queries of masks as pixel sets: algebra, cores, cells, blobs, overlaps, suppression, roofs and stored instances."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import focal, footprints, graph, instances, mesh
from rasterloom.plans.join_queries import POLY_SQL, polygons
from rasterloom.plans.join_queries import registry as join_registry
from rasterloom.plans.mesh_queries import MASK_SQL, MESH_SQL, PAINT_SQL, masks, sheet
from rasterloom.plans.registry import Registry, rounded
from rasterloom.plans.score_queries import metres
from rasterloom.session import shared_folder
from rasterloom.sources import views

registry = Registry()
N = views.GRID
FILL_SQL = join_registry.sql["fill_polygon"]
BLOB_SQL = join_registry.sql["connected_components"]


@registry.add(f'SELECT DISTINCT scene_id, "row", col FROM ({FILL_SQL})')
def building_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.building_mask(polygons(spark, sf_dir), N, N)


@registry.add(f"WITH {POLY_SQL} SELECT feature_id, scene_id FROM corners GROUP BY ALL HAVING NOT (max(py) < -4 OR max(px) < -4 OR min(py) > 24 OR min(px) > 34)")
def features_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints within four pixels of a window of 20 x 30."""
    return footprints.features_touching(polygons(spark, sf_dir), 20, 30, 4.0).select("feature_id", "scene_id")


@registry.add(MASK_SQL + """, a AS (SELECT DISTINCT scene_id, "row", col FROM mask_px WHERE mask_id % 2 = 0), b AS (SELECT DISTINCT scene_id, "row", col FROM mask_px WHERE mask_id % 2 = 1)
SELECT 'both' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'any', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of even and of odd numbers: what both cover, any covers, and the even alone."""
    own = masks(spark, sf_dir)
    a, b = own.filter("mask_id % 2 = 0"), own.filter("mask_id % 2 = 1")
    kinds = (("both", footprints.mask_intersect(a, b)), ("any", footprints.mask_union(a, b)), ("only", footprints.mask_minus(a, b)))
    first, *rest = (df.select(F.lit(k).alias("kind"), "scene_id", "row", "col") for k, df in kinds)
    for df in rest:
        first = first.unionByName(df)
    return first


@registry.add(MASK_SQL + f""", c AS (SELECT a.scene_id, a.mask_id, a."row", a.col FROM mask_px a JOIN mask_px b ON b.mask_id = a.mask_id AND abs(b."row" - a."row") <= 2 AND abs(b.col - a.col) <= 2 GROUP BY ALL HAVING count(*) = 25),
r AS (SELECT DISTINCT scene_id, mask_id, CAST("row" + i.range AS INTEGER) AS "row", CAST(col + j.range AS INTEGER) AS col FROM mask_px, range(-3, 4) i, range(-3, 4) j)
SELECT scene_id, mask_id, "row", col, 'core' AS part FROM c UNION ALL SELECT scene_id, mask_id, "row", col, 'ring' FROM (SELECT * FROM r WHERE "row" BETWEEN 0 AND {N - 1} AND col BETWEEN 0 AND {N - 1} EXCEPT SELECT scene_id, mask_id, "row", col FROM mask_px)""")
def core_and_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.core_and_ring(masks(spark, sf_dir), N, N)


@registry.add(MASK_SQL + """SELECT a.scene_id, a.mask_id, a."row", a.col FROM mask_px a JOIN mask_px b ON b.mask_id = a.mask_id AND b."row" = a."row" AND b.col = a.col + 1
JOIN mask_px c ON c.mask_id = a.mask_id AND c."row" = a."row" + 1 AND c.col = a.col JOIN mask_px d ON d.mask_id = a.mask_id AND d."row" = a."row" + 1 AND d.col = a.col + 1""")
def to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.to_cells(masks(spark, sf_dir))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(views.px(spark, sf_dir).filter("g < 75"), N, 2)


_SHAPE_SQL = f"""SELECT scene_id, component, count(*) AS area_px, round(avg("row"), 6) AS centroid_row, round(avg(col), 6) AS centroid_col, min("row") AS r0, min(col) AS c0, max("row") + 1 AS r1, max(col) + 1 AS c1,
  round(greatest(max("row") + 1 - min("row"), max(col) + 1 - min(col)) / least(max("row") + 1 - min("row"), max(col) + 1 - min(col)), 6) AS elongation FROM ({BLOB_SQL}) GROUP BY scene_id, component"""


@registry.add(_SHAPE_SQL)
def blob_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(footprints.blob_shape(blobs(spark, sf_dir)))


@registry.add(f"SELECT * FROM ({_SHAPE_SQL}) QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY area_px DESC, component) = 1")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component of each scene."""
    return rounded(footprints.largest(footprints.blob_shape(blobs(spark, sf_dir))))


@registry.add(f"""WITH c AS MATERIALIZED ({BLOB_SQL}), r AS (SELECT DISTINCT scene_id, component, "row" + i.range AS "row", col + j.range AS col FROM c, range(-5, 6) i, range(-5, 6) j),
o AS (SELECT r.* FROM r LEFT JOIN c ON c.scene_id = r.scene_id AND c.component = r.component AND c."row" = r."row" AND c.col = r.col WHERE c.component IS NULL AND r."row" BETWEEN 0 AND {N - 1} AND r.col BETWEEN 0 AND {N - 1})
SELECT o.scene_id, o.component, round(1 - count(c.component) / count(*), 6) AS isolation FROM o LEFT JOIN c ON c.scene_id = o.scene_id AND c."row" = o."row" AND c.col = o.col GROUP BY ALL""")
def isolation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(footprints.isolation_score(blobs(spark, sf_dir), N, N, 5))


@registry.add(MASK_SQL + f""", poly AS ({FILL_SQL}), na AS (SELECT mask_id, count(*) AS n FROM mask_px GROUP BY ALL), nb AS (SELECT feature_id, count(*) AS n FROM poly GROUP BY ALL),
k AS (SELECT a.scene_id, a.mask_id, b.feature_id, count(*) AS k FROM mask_px a JOIN poly b ON b.scene_id = a.scene_id AND b."row" = a."row" AND b.col = a.col GROUP BY ALL),
u AS (SELECT k.scene_id, k.mask_id, k.feature_id, k / (na.n + nb.n - k) AS iou FROM k JOIN na USING (mask_id) JOIN nb USING (feature_id))
SELECT scene_id, mask_id, round(iou, 6) AS iou, CASE WHEN iou >= 0.3 THEN feature_id END AS feature_id FROM u QUALIFY row_number() OVER (PARTITION BY scene_id, mask_id ORDER BY round(iou, 12) DESC, feature_id) = 1""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The footprint that each mask overlaps most, adopted from an IoU of 0.3 on."""
    from rasterloom.operators import joins

    return rounded(footprints.best_overlap(masks(spark, sf_dir), joins.fill_polygon(polygons(spark, sf_dir), N, N), 0.3))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    y0, x0 = (k * 13 % 56).cast("int"), (k * 29 % 56).cast("int")
    return views.read(spark, sf_dir, "part").select(
        views.scene_of("p_partkey", views.PARTS_A_SCENE), k.alias("mask_id"), y0.alias("y0"), x0.alias("x0"), (y0 + 8 + F.col("p_size") % 9).cast("int").alias("y1"), (x0 + 8 + F.col("p_size") * 7 % 8).cast("int").alias("x1"),
        (F.round(F.col("p_retailprice") * 100).cast("long") % 1000).alias("score"), ((8 + F.col("p_size") % 9) * (8 + F.col("p_size") * 7 % 8)).cast("long").alias("area_px"),
    )


@registry.add()
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression of overlapping boxes; tests hold it against brute force."""
    return footprints.box_nms(boxes(spark, sf_dir), 0.3)


@registry.add(
    MASK_SQL
    + """, k AS (SELECT b.scene_id, mask_id, (ref_mm % 30000) / 1000.0 AS z, b."row" AS y, b.col AS x FROM mask_px b JOIN px p ON p.scene_id = b.scene_id AND p."row" = b."row" AND p.col = b.col),
l AS (SELECT scene_id, mask_id, count(*) AS n, median(z) AS med FROM k GROUP BY ALL), f AS (SELECT scene_id, mask_id, n, med, sqrt(avg(pow(z - med, 2))) AS flat FROM k JOIN l USING (scene_id, mask_id) GROUP BY ALL)
SELECT scene_id, mask_id, n, round(med, 6) AS platform_m FROM f"""
)
def choose_roof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and median height of every roof; its mode, plane and inliers are held against brute force in tests."""
    px = metres(spark, sf_dir).select("scene_id", "row", "col", F.col("h_ref").alias("z"))
    out = rounded(footprints.choose_roof(masks(spark, sf_dir).join(px, ["scene_id", "row", "col"])))
    return out.filter(F.col("mode").isNotNull()).select("scene_id", "mask_id", "n", "platform_m")


@registry.add(
    MESH_SQL
    + """, c AS (SELECT scene_id, vid, sum(cx) AS x, sum(cy) AS y, sum(cz) AS z FROM (SELECT f.scene_id, unnest([a, b, c]) AS vid, cx, cy, cz FROM f JOIN n USING (scene_id, fid)) GROUP BY scene_id, vid)
SELECT scene_id, vid, round(x / l, 6) + 0::DOUBLE AS nx, round(y / l, 6) + 0::DOUBLE AS ny, round(z / l, 6) + 0::DOUBLE AS nz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM c)"""
)
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.vertex_normals(*sheet(spark, sf_dir)))


@registry.add(
    PAINT_SQL
    + f""", w AS (SELECT g.scene_id, g."row", g.col, s.instance FROM grid g LEFT JOIN s USING (scene_id, "row", col) WHERE g.scene_id IN (SELECT scene_id FROM s))
SELECT a.scene_id, a."row", a.col, a.instance, bool_or(a.instance IS DISTINCT FROM b.instance) AS boundary FROM w a JOIN w b ON b.scene_id = a.scene_id AND abs(b."row" - a."row") + abs(b.col - a.col) = 1 WHERE a.instance IS NOT NULL GROUP BY ALL"""
)
def read_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instance map written and read back, with boundaries taken anew."""
    path = f"{shared_folder(spark)}/instances-{uuid.uuid4().hex}"
    instances.write_instances(*instances.paint_instances(masks(spark, sf_dir), 12), path)
    grid = views.full_grid(spark, sf_dir)
    return instances.read_instances(spark, path, grid)[1]


@registry.add("SELECT name, n FROM (SELECT 'scene ' || lpad((p_partkey // 128)::VARCHAR, 6, '0') AS name, count(*) AS n FROM part GROUP BY ALL) ORDER BY name LIMIT 3")
def first_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three scenes by name (a report)."""
    name = F.concat(F.lit("scene "), F.lpad(F.expr("cast(p_partkey div 128 as string)"), 6, "0"))
    return views.read(spark, sf_dir, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy("name").limit(3)


@registry.add("SELECT l_returnflag AS layer, CAST(sum(l_quantity) AS BIGINT) AS bytes, CAST(rank() OVER (ORDER BY CAST(sum(l_quantity) AS BIGINT) DESC, l_returnflag) AS INTEGER) AS place FROM lineitem GROUP BY l_returnflag")
def layers_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers by falling size; the window sees one row a layer."""
    from pyspark.sql import Window as W

    sums = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("layer")).agg(F.sum("l_quantity").cast("long").alias("bytes"))
    return sums.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("bytes"), "layer")))


@registry.add()
def snap_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks whose outlines moved onto the edges of their scene's luminance."""
    light = (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) / 255.0
    return footprints.snap_footprint(masks(spark, sf_dir), views.px(spark, sf_dir).withColumn("light", light), "light", N, N)
