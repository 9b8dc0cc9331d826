"""Raster, anchor, vector and scene views over star-schema tables, and the same views as SQL.

They give the operators inputs that grow with the tables: every ORDERS_A_SCENE orders are a scene
of ``n`` by ``n`` pixels, with masks, lines and polygons from blocks of parts and suppliers. All
values come from integers, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import spread

GRID = 64
#: Keys that share a scene. About a third of the pixels of a scene have no row.
ORDERS_A_SCENE, PARTS_A_SCENE, SUPPLIERS_A_SCENE = 1024, 128, 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_of(key: str, size: int) -> Column:
    """The scene of a key."""
    return F.expr(f"cast({key} div {size} as int)").alias("scene_id")


def _items(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The rows of lineitem with the pixel that each falls on."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    off = F.round(F.col("l_discount") * 100).cast("long")
    return read(spark, sf_dir, "lineitem").select(
        scene_of("l_orderkey", ORDERS_A_SCENE),
        (F.col("l_orderkey") % n).cast("int").alias("row"),
        (F.col("l_partkey") % n).cast("int").alias("col"),
        cents.alias("ref"),
        (cents * (100 - off)).alias("pred"),
        F.col("l_quantity").cast("long").alias("q"),
        F.col("l_suppkey").alias("s"),
    )


def _measured(cells: DataFrame) -> DataFrame:
    """The columns of ``px`` from sums over each pixel; null where ``n`` is 0."""
    some = F.when(F.col("n") > 0, F.col("n"))
    ref, pred = F.expr("ref_sum div n"), F.expr("pred_sum div (100 * n)")
    own = cells.withColumn("n", some)
    out = own.select("scene_id", "row", "col", ref.alias("ref_mm"), pred.alias("pred_mm"), (500 + F.col("q") * 97 % 4000).alias("sigma_mm"), (F.col("s") % 5).cast("int").alias("sem"))
    return out.withColumns(
        {
            "r": (F.col("ref_mm") % 256).cast("int"),
            "g": (F.expr("pred_mm div 7") % 256).cast("int"),
            "b": ((F.expr("ref_mm div 3") + F.col("pred_mm")) % 256).cast("int"),
        }
    )


def _sums() -> list[Column]:
    return [F.sum("ref").alias("ref_sum"), F.sum("pred").alias("pred_sum"), F.sum("q").alias("q"), F.min("s").alias("s")]


def px(spark: SparkSession, sf_dir: str, n: int = GRID) -> DataFrame:
    """scene_id, row, col, and per pixel: ref_mm, pred_mm, sigma_mm, sem and r, g, b; cells without rows are absent."""
    return _measured(_items(spark, sf_dir, n).groupBy("scene_id", "row", "col").agg(F.count("*").alias("n"), *_sums()))


def full_grid(spark: SparkSession, sf_dir: str, n: int = GRID, w: int | None = None) -> DataFrame:
    """Every (scene_id, row, col) of ``n`` rows and ``w`` columns (as many as rows) of the scenes that have orders."""
    ids = read(spark, sf_dir, "orders").select(scene_of("o_orderkey", ORDERS_A_SCENE)).distinct()
    line = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    return spread(ids.select("scene_id", line(n).alias("row")), "scene_id", "row").select("scene_id", "row", line(w or n).alias("col"))


def px_full(spark: SparkSession, sf_dir: str, n: int = GRID) -> DataFrame:
    """``px`` on the whole grid, null where there is no pixel; never broadcast, because Spark takes it for as small as its orders.

    Rows of lineitem and lines of the grid move once, to the task of their line, and a line becomes
    pixels only there. It is partitioned by (scene, row), which windows along rows need.
    """
    lines = full_grid(spark, sf_dir, n, 1).select("scene_id", "row", F.lit(True).alias("grid"))
    both = spread(_items(spark, sf_dir, n).unionByName(lines, allowMissingColumns=True), "scene_id", "row")
    cols = F.when(F.col("grid"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array("col"))
    own = both.select("scene_id", "row", F.explode(cols).alias("col"), "grid", "ref", "pred", "q", "s")
    cells = own.groupBy("scene_id", "row", "col").agg(F.count_if(F.col("grid").isNull()).alias("n"), F.max("grid").alias("grid"), *_sums()).filter("grid")
    return _measured(cells).hint("merge")


def surface(spark: SparkSession, sf_dir: str, n: int = GRID) -> DataFrame:
    """scene_id, row, col and ``z``, metres with a value in every cell (0 where ``px`` has none)."""
    return px_full(spark, sf_dir, n).select("scene_id", "row", "col", (F.coalesce("ref_mm", F.lit(0)) % 100_000 / 1000.0).alias("z"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, transform (six numbers), is_geographic, lat, lon, sun_el, crs; nulls where the key says so."""
    k = F.col("n_nationkey")
    step = 0.25 + k % 4 * 0.25
    return read(spark, sf_dir, "nation").select(
        k.alias("scene_id"),
        F.when(k % 7 != 3, F.array(step, F.lit(0.0), k * 1000.0, F.lit(0.0), -step * (1 + k % 2), k * -500.0)).alias("transform"),
        (k % 5 == 0).alias("is_geographic"),
        (k * 5.0 - 60).alias("lat"),
        (k * 13.0 - 150).alias("lon"),
        F.when(k % 9 != 4, 12 + k * 3.1).alias("sun_el"),
        F.when(k % 6 != 2, "EPSG:32644").alias("crs"),
    )


def anchors(spark: SparkSession, sf_dir: str, n: int = GRID) -> DataFrame:
    """anchor_id, scene_id, row, col, value_mm, source, weight and whether the anchor is relative, from orders."""
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        o.alias("anchor_id"),
        scene_of("o_orderkey", ORDERS_A_SCENE),
        (o % n).cast("int").alias("row"),
        (F.expr("o_orderkey div 3") % n).cast("int").alias("col"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("value_mm"),
        F.substring("o_orderpriority", 1, 1).alias("source"),
        (F.substring("o_orderpriority", 1, 1).cast("int") / 5.0).alias("weight"),
        (F.col("o_orderstatus") == "O").alias("relative"),
    )


#: The same views in SQL.
PX_SQL = f"""
cells AS (
  SELECT CAST(l_orderkey // {ORDERS_A_SCENE} AS INTEGER) AS scene_id, CAST(l_orderkey % {GRID} AS INTEGER) AS "row",
         CAST(l_partkey % {GRID} AS INTEGER) AS col, count(*) AS n,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS ref_sum,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS pred_sum,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, min(l_suppkey) AS s
  FROM lineitem GROUP BY 1, 2, 3
), px AS (
  SELECT scene_id, "row", col, ref_sum // n AS ref_mm, pred_sum // (100 * n) AS pred_mm,
         500 + q * 97 % 4000 AS sigma_mm, CAST(s % 5 AS INTEGER) AS sem,
         CAST((ref_sum // n) % 256 AS INTEGER) AS r, CAST((pred_sum // (100 * n) // 7) % 256 AS INTEGER) AS g,
         CAST(((ref_sum // n) // 3 + pred_sum // (100 * n)) % 256 AS INTEGER) AS b
  FROM cells
)"""
FULL_SQL = f"""{PX_SQL}, grid AS (
  SELECT s.scene_id, CAST(y.range AS INTEGER) AS "row", CAST(x.range AS INTEGER) AS col
  FROM (SELECT DISTINCT CAST(o_orderkey // {ORDERS_A_SCENE} AS INTEGER) AS scene_id FROM orders) s, range({GRID}) y, range({GRID}) x
), px_full AS (
  SELECT * FROM grid LEFT JOIN px USING (scene_id, "row", col)
), surface AS (
  SELECT scene_id, "row", col, (coalesce(ref_mm, 0) % 100000) / 1000.0 AS z FROM px_full
)"""
SCENES_SQL = """
scenes AS (
  SELECT n_nationkey AS scene_id,
         CASE WHEN n_nationkey % 7 <> 3 THEN [0.25 + n_nationkey % 4 * 0.25, 0.0, n_nationkey * 1000.0, 0.0,
              -(0.25 + n_nationkey % 4 * 0.25) * (1 + n_nationkey % 2), n_nationkey * -500.0] END::DOUBLE[] AS transform,
         n_nationkey % 5 = 0 AS is_geographic, CAST(n_nationkey * 5.0 - 60 AS DOUBLE) AS lat,
         CAST(n_nationkey * 13.0 - 150 AS DOUBLE) AS lon,
         CAST(CASE WHEN n_nationkey % 9 <> 4 THEN 12 + n_nationkey * 3.1 END AS DOUBLE) AS sun_el,
         CASE WHEN n_nationkey % 6 <> 2 THEN 'EPSG:32644' END AS crs
  FROM nation
)"""
ANCHORS_SQL = f"""
anchors AS (
  SELECT o_orderkey AS anchor_id, CAST(o_orderkey // {ORDERS_A_SCENE} AS INTEGER) AS scene_id, CAST(o_orderkey % {GRID} AS INTEGER) AS "row",
         CAST((o_orderkey // 3) % {GRID} AS INTEGER) AS col, CAST(round(o_totalprice * 100) AS BIGINT) AS value_mm,
         substr(o_orderpriority, 1, 1) AS source, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) / 5.0::DOUBLE AS weight,
         o_orderstatus = 'O' AS relative
  FROM orders
)"""
