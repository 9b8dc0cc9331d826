"""Instance masks: painting, boxes, zonal measures and roof planes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators import focal
from rasterloom.session import written_pixels as written


def mask_bbox(mask_px: DataFrame) -> DataFrame:
    """scene_id, mask_id, area_px and the inclusive box y0, x0, y1, x1."""
    return mask_px.groupBy("scene_id", "mask_id").agg(
        F.count("*").alias("area_px"), F.min("row").alias("y0"), F.min("col").alias("x0"), F.max("row").alias("y1"), F.max("col").alias("x1")
    )


def paint_instances(mask_px: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, pixels): masks of at least ``least`` pixels get ids by falling area (ties by mask_id); of those on a pixel the smallest shows.

    The numbering window sees one row per mask.
    """
    area = mask_px.groupBy("scene_id", "mask_id").agg(F.count("*").alias("area_px")).filter(F.col("area_px") >= least)
    order = W.partitionBy("scene_id").orderBy(F.desc("area_px"), "mask_id")
    named = area.withColumn("instance", F.row_number().over(order))
    shown = mask_px.join(named.select("scene_id", "mask_id", "instance"), ["scene_id", "mask_id"]).groupBy("scene_id", "row", "col").agg(F.max("instance").alias("instance"))
    visible = shown.groupBy("scene_id", "instance").agg(F.count("*").alias("visible_px"))
    records = named.join(visible, ["scene_id", "instance"], "left").na.fill(0, ["visible_px"])
    return records.select("scene_id", "instance", "mask_id", "area_px", "visible_px"), shown


def write_instances(records: DataFrame, pixels: DataFrame, path: str) -> None:
    """Writes the records and the id map of ``paint_instances``."""
    records.write.parquet(f"{path}/records")
    pixels.select("scene_id", "row", "col", "instance").write.parquet(f"{path}/pixels")


def read_instances(spark: SparkSession, path: str, grid: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(records, pixels with ``boundary``, taken anew on ``grid``); None where nothing is stored."""
    try:
        records, pixels = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/pixels")
    except AnalysisException:
        return None
    whole = grid.join(pixels.select("scene_id").distinct(), "scene_id", "left_semi").join(pixels, ["scene_id", "row", "col"], "left")
    return records, focal.boundaries(whole, "instance").filter("instance is not null")


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """scene_id, a, b and IoU of every two masks that share a pixel; pairs come from shared pixels, not from all pairs."""
    na = a.groupBy("scene_id", F.col("mask_id").alias("a")).agg(F.count("*").alias("na"))
    nb = b.groupBy("scene_id", F.col("mask_id").alias("b")).agg(F.count("*").alias("nb"))
    both = a.withColumnRenamed("mask_id", "a").join(b.withColumnRenamed("mask_id", "b"), ["scene_id", "row", "col"]).groupBy("scene_id", "a", "b").agg(F.count("*").alias("n"))
    out = both.join(na, ["scene_id", "a"]).join(nb, ["scene_id", "b"])
    return out.select("scene_id", "a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("iou"))


def grown(mask_px: DataFrame, key: str, radius: int) -> DataFrame:
    """Pixels within ``radius`` of each mask (a box); never broadcast.

    The pixels of a line become runs, longer by ``radius`` at both ends. Only runs are sent to the
    lines above and below, where those that meet are joined before they are pixels again.
    """
    line = ["scene_id", key, "row"]
    cols = mask_px.groupBy(*line).agg(F.sort_array(F.collect_set("col")).alias("_cols"))
    apart = lambda k: F.filter("_cols", lambda x, i: ~F.coalesce(F.get("_cols", i + k) == x + k, F.lit(False)))
    ends = cols.select(*line, F.explode(F.arrays_zip(apart(-1).alias("a"), apart(1).alias("b"))).alias("_e"))
    rows = F.explode(F.sequence(F.col("row") - radius, F.col("row") + radius)).alias("row")
    runs = ends.select("scene_id", key, rows, (F.col("_e.a") - radius).alias("_a"), (F.col("_e.b") + radius).alias("_b"))
    # A run starts anew where none before it reaches that far.
    order = W.partitionBy(*line).orderBy("_a", "_b")
    upto = F.max("_b").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = runs.withColumn("_new", F.when(F.col("_a") <= upto + 1, 0).otherwise(1))
    whole = new.withColumn("_k", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*line, "_k").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return whole.select(*line, F.explode(F.sequence("_a", "_b")).alias("col")).hint("merge")


def shrunk(mask_px: DataFrame, key: str, radius: int) -> DataFrame:
    """Pixels whose whole box of ``radius`` lies in their mask."""
    own = mask_px.select("scene_id", key, "row", "col").distinct()
    for across, along in (("row", "col"), ("col", "row")):
        near = W.partitionBy("scene_id", key, across).orderBy(along).rangeBetween(-radius, radius)
        own = own.withColumn("_n", F.count("*").over(near)).filter(F.col("_n") == 2 * radius + 1).drop("_n")
    return own


#: Fixed values of what a building is: pixels, roof pixels, share of vegetation (refused, noted), height and scatter in metres.
LEAST_PX, LEAST_ROOF, MOST_GREEN, SOME_GREEN, LEAST_HEIGHT_M, MOST_SCATTER_M = 40, 8, 0.6, 0.3, 2.5, 4.0


def zonal_measure(mask_px: DataFrame, px: DataFrame, height: str, ring: int = 3, vegetation: int = 3, edge: int = 2, ground: str | None = None) -> DataFrame:
    """Per mask: pixels and roof pixels, roof median, median deviation from it and share of outliers, ground median, height, share of vegetation, why it is refused, and a note.

    The roof is read ``edge`` pixels inside the mask (of a mask without such pixels, all over).
    The ring holds pixels within ``ring`` of the mask that belong to no mask; with ``ground``, a
    column of bare earth, those outside this mask. Outliers are off the median by over three median deviations.
    """
    keys = ["scene_id", "mask_id"]
    cols = ["sem", height] if ground is None else ["sem", height, ground]
    inner = shrunk(mask_px, "mask_id", edge).withColumn("_in", F.lit(True))
    own = mask_px.join(px.select("scene_id", "row", "col", *dict.fromkeys(cols)), ["scene_id", "row", "col"]).join(inner, [*keys, "row", "col"], "left")
    own = written(own.select(*keys, "sem", F.col(height).alias("_h"), F.coalesce("_in", F.lit(False)).alias("_in")), "zones")
    inside = F.when(F.col("_in"), F.col("_h"))
    roof = own.groupBy(*keys).agg(
        F.count("_h").alias("n_px"), F.count_if("_in").alias("_n_in"), F.count(inside).alias("_nc"), F.median(inside).alias("_rc"), F.median("_h").alias("_rm"), F.avg((F.col("sem") == vegetation).cast("double")).alias("vegetation")
    )
    cored = F.col("_n_in") > 0
    roof = roof.select(*keys, "n_px", F.when(cored, F.col("_nc")).otherwise(F.col("n_px")).alias("n_roof"), F.when(cored, F.col("_rc")).otherwise(F.col("_rm")).alias("roof_m"), "vegetation", cored.alias("_cored"))
    off = own.join(roof, keys).filter(F.col("_in") | ~F.col("_cored")).select(*keys, F.abs(F.col("_h") - F.col("roof_m")).alias("_off"))
    spread = off.groupBy(*keys).agg(F.median("_off").alias("mad_m"))
    odd = off.join(spread, keys).groupBy(*keys).agg(F.avg((F.col("_off") > 3 * F.greatest("mad_m", F.lit(1e-3))).cast("double")).alias("outlier_share"))
    around = grown(mask_px, "mask_id", ring)
    free = around.join(mask_px.select("scene_id", "row", "col").distinct(), ["scene_id", "row", "col"], "left_anti") if ground is None else around.join(mask_px.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti")
    level = free.join(px.select("scene_id", "row", "col", F.col(ground or height).alias("_g")), ["scene_id", "row", "col"]).groupBy(*keys).agg(F.median("_g").alias("ground_m"))
    out = roof.drop("_cored").join(spread, keys, "left").join(odd, keys, "left").join(level, keys, "left")
    out = out.withColumn("height_m", F.col("roof_m") - F.col("ground_m"))
    refused = (
        F.when(F.col("n_px") < LEAST_PX, "small").when(F.col("n_roof") < LEAST_ROOF, "few roof pixels").when(F.col("ground_m").isNull(), "no ground")
        .when(F.col("vegetation") > MOST_GREEN, "vegetation").when(F.col("height_m") < LEAST_HEIGHT_M, "low")
    )
    green = F.when(F.col("vegetation") > SOME_GREEN, F.concat(F.bround(F.col("vegetation") * 100, 0).cast("int"), F.lit("% of this footprint reads as vegetation")))
    loose = F.when(F.col("mad_m") > MOST_SCATTER_M, F.concat(F.lit("roof height scatters by "), F.format_string("%.1f", "mad_m"), F.lit(" m MAD")))
    return out.withColumn("refused", refused).withColumn("note", F.concat_ws("; ", green, loose))


def fit_plane(points: DataFrame, by: tuple[str, ...] = ("scene_id", "mask_id"), z: str = "z") -> DataFrame:
    """Per group the least-squares plane z = a col + b row + c, by Cramer's rule on centred sums, with its RMSE; null slopes for points on a line."""
    means = points.groupBy(*by).agg(F.avg("col").alias("mx"), F.avg("row").alias("my"), F.avg(z).alias("mz"))
    x, y, v = F.col("col") - F.col("mx"), F.col("row") - F.col("my"), F.col(z) - F.col("mz")
    s = points.join(means, list(by)).groupBy(*by, "mx", "my", "mz").agg(
        F.count(z).alias("n"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x * v).alias("xz"), F.sum(y * v).alias("yz"), F.sum(v * v).alias("zz")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    flat = F.when(F.abs(det) > 1e-9, det)
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / flat
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / flat
    rest = F.col("zz") - a * F.col("xz") - b * F.col("yz")
    return s.select(*by, "n", a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"), F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n")).alias("rmse"))


def best_window(px: DataFrame, height: str, size: int, step: int, h: int, w: int, least: float = 3.0) -> DataFrame:
    """Per scene the square window (multiple of ``step``) with the largest share of pixels above ``least``; the first in scan order of equals.

    Pixels are counted by blocks of ``step``; windows sum blocks, so the raster moves once.
    """
    k = size // step
    block = lambda c: F.expr(f"cast({c} div {step} as int)")
    blocks = px.groupBy("scene_id", block("row").alias("br"), block("col").alias("bc")).agg(F.count_if(F.col(height) > least).alias("tall"))
    reach = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k) for j in range(k))))
    wins = blocks.select("scene_id", "tall", "br", "bc", reach.alias("o"))
    wins = wins.select("scene_id", "tall", ((F.col("br") - F.col("o.i")) * step).alias("row"), ((F.col("bc") - F.col("o.j")) * step).alias("col"))
    wins = wins.filter(F.col("row").between(0, h - size) & F.col("col").between(0, w - size)).groupBy("scene_id", "row", "col").agg(F.sum("tall").alias("tall"))
    best = wins.groupBy("scene_id").agg(F.max_by(F.struct("row", "col", "tall"), F.struct("tall", -F.col("row"), -F.col("col"))).alias("b"))
    return best.select("scene_id", "b.row", "b.col", (F.col("b.tall") / (size * size)).alias("share"))
