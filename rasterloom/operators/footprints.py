"""Operators on masks as pixel sets: algebra, cores and rings, cells, blobs, overlaps, suppression, and roofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators import graph, instances, joins
from rasterloom.operators.instances import grown, shrunk
from rasterloom.session import written_pixels as written

PIXEL = ("scene_id", "row", "col")


def building_mask(polygons: DataFrame, h: int, w: int) -> DataFrame:
    """All pixels inside any footprint of a scene."""
    return joins.fill_polygon(polygons, h, w).select(*PIXEL).distinct()


def features_touching(features: DataFrame, h: int, w: int, pad: float = 64.0) -> DataFrame:
    """Features whose box comes within ``pad`` pixels of the raster."""
    rows, cols = F.col("pts.y"), F.col("pts.x")
    r0, r1, c0, c1 = F.array_min(rows), F.array_max(rows), F.array_min(cols), F.array_max(cols)
    return features.filter(~((r1 < -pad) | (c1 < -pad) | (r0 > h + pad) | (c0 > w + pad)))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).union(b.select(*PIXEL)).distinct()


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).distinct().join(b.select(*PIXEL).distinct(), list(PIXEL), "left_semi")


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).distinct().join(b.select(*PIXEL).distinct(), list(PIXEL), "left_anti")


def core_and_ring(mask_px: DataFrame, h: int, w: int, key: str = "mask_id", core: int = 2, ring: int = 3) -> DataFrame:
    """scene_id, key, row, col and ``part``: the core of each mask, ``core`` pixels in, and the ring of ``ring`` pixels around it."""
    inner = shrunk(mask_px, key, core).withColumn("part", F.lit("core"))
    around = grown(mask_px, key, ring).join(mask_px.select("scene_id", key, "row", "col").distinct(), ["scene_id", key, "row", "col"], "left_anti")
    around = around.filter(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1))
    return inner.unionByName(around.withColumn("part", F.lit("ring")))


def to_cells(mask_px: DataFrame, key: str = "mask_id") -> DataFrame:
    """Cells (named by their north-west pixel) whose four corners all lie in the mask."""
    corners = F.array(*(F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col")) for i in (0, 1) for j in (0, 1)))
    own = mask_px.select("scene_id", key, "row", "col").distinct()
    return own.select("scene_id", key, F.explode(corners).alias("c")).groupBy("scene_id", key, "c.row", "c.col").agg(F.count("*").alias("n")).filter("n = 4").drop("n")


def blob_shape(components: DataFrame) -> DataFrame:
    """scene_id, component, area, centroid, half-open box and elongation (longer over shorter side) of labelled pixels."""
    out = components.groupBy("scene_id", "component").agg(
        F.count("*").alias("area_px"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"),
        F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"),
    )
    high, wide = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    return out.withColumn("elongation", F.greatest(high, wide) / F.least(high, wide))


def largest(components: DataFrame, by: tuple[str, ...] = ("scene_id",), size: str = "area_px", key: str = "component") -> DataFrame:
    """The row of largest ``size`` of each group, ties by the least key."""
    return components.groupBy(*by).agg(F.max_by(F.struct(*(c for c in components.columns if c not in by)), F.struct(size, -F.col(key))).alias("b")).select(*by, "b.*")


def isolation_score(components: DataFrame, h: int, w: int, ring: int = 12) -> DataFrame:
    """scene_id, component and 1 less the share of other components' pixels in the ring of ``ring`` pixels around each; 1 without a ring."""
    own = components.select("scene_id", "component", "row", "col")
    around = grown(own, "component", ring).filter(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1))
    around = around.join(own, ["scene_id", "component", "row", "col"], "left_anti")
    others = own.select(*PIXEL).distinct().withColumn("_o", F.lit(1))
    share = around.join(others, list(PIXEL), "left").groupBy("scene_id", "component").agg((F.count("_o") / F.count("*")).alias("share"))
    return own.select("scene_id", "component").distinct().join(share, ["scene_id", "component"], "left").select("scene_id", "component", (1 - F.coalesce("share", F.lit(0.0))).alias("isolation"))


def best_overlap(mask_px: DataFrame, polygon_px: DataFrame, least: float = 0.5) -> DataFrame:
    """scene_id, mask_id, iou of the polygon that overlaps most (ties by the least id), and ``feature_id`` where it is adopted."""
    pairs = instances.mask_iou(mask_px.select("scene_id", "mask_id", "row", "col"), polygon_px.select("scene_id", F.col("feature_id").alias("mask_id"), "row", "col"))
    best = pairs.groupBy("scene_id", F.col("a").alias("mask_id")).agg(F.max_by(F.struct("b", "iou"), F.struct(F.round("iou", 12), -F.col("b"))).alias("m"))
    return best.select("scene_id", "mask_id", F.col("m.iou").alias("iou"), F.when(F.col("m.iou") >= least, F.col("m.b")).alias("feature_id"))


def box_nms(boxes: DataFrame, iou: float = 0.7, cell: int = 64) -> DataFrame:
    """Boxes (scene_id, mask_id, y0, x0, y1, x1 exclusive, score, area_px) that greedy suppression keeps, with their rank by falling area.

    Boxes that overlap share a grid cell, so pairs come from cells. Each round keeps the boxes
    that no better box is left to suppress and drops what they suppress; ties go to the least id.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    cells = boxes.select("*", span("y0", "y1").alias("gy")).select("*", span("x0", "x1").alias("gx"))
    left, right = cells.alias("p"), cells.alias("q")
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("scene_id", "gy", "gx")]
    better = (F.col("p.score") > F.col("q.score")) | ((F.col("p.score") == F.col("q.score")) & (F.col("p.mask_id") < F.col("q.mask_id")))
    side = lambda a, b: F.greatest(F.least(F.col(f"p.{b}"), F.col(f"q.{b}")) - F.greatest(F.col(f"p.{a}"), F.col(f"q.{a}")), F.lit(0))
    area = lambda t: (F.col(f"{t}.y1") - F.col(f"{t}.y0")) * (F.col(f"{t}.x1") - F.col(f"{t}.x0"))
    both = side("y0", "y1") * side("x0", "x1")
    over = left.join(right, [*on, better]).filter(both > iou * (area("p") + area("q") - both))
    over = written(over.select(F.col("p.scene_id").alias("scene_id"), F.col("p.mask_id").alias("win"), F.col("q.mask_id").alias("lose")).distinct(), "suppress")
    state = written(boxes.select("scene_id", "mask_id").withColumn("kept", F.lit(None).cast("boolean")), "state")
    while True:
        live = state.filter("kept is null")
        if live.isEmpty():
            break
        mark = lambda name, df: df.select("scene_id", F.col("mask_id").alias(name))
        open_pairs = over.join(mark("win", live), ["scene_id", "win"]).join(mark("lose", live), ["scene_id", "lose"])
        wins = mark("mask_id", live).join(mark("mask_id", open_pairs.select("scene_id", F.col("lose").alias("mask_id"))), ["scene_id", "mask_id"], "left_anti").withColumn("now", F.lit(True))
        loses = over.join(wins.select("scene_id", F.col("mask_id").alias("win")), ["scene_id", "win"]).select("scene_id", F.col("lose").alias("mask_id")).distinct().withColumn("now", F.lit(False))
        said = wins.unionByName(loses).groupBy("scene_id", "mask_id").agg(F.max("now").alias("now"))
        state = written(state.join(said, ["scene_id", "mask_id"], "left").select("scene_id", "mask_id", F.coalesce("kept", "now").alias("kept")), "state")
    kept = boxes.join(state.filter("kept").select("scene_id", "mask_id"), ["scene_id", "mask_id"])
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("area_px"), "mask_id")))


def refit_plane(points: DataFrame, by: tuple[str, ...] = ("scene_id", "mask_id"), z: str = "z", tolerance: float = 0.6, least: int = 8) -> DataFrame:
    """Per group the plane z = a col + b row + c, fitted again without points off it by more than the larger of ``tolerance`` and three median deviations; n, share of points within ``tolerance`` and RMSE over all points.

    There is no second fit where it would drop none, or leave under ``least`` points; groups of
    under ``least`` points have no plane and a share of 0.
    """
    keys = list(by)
    own = points.filter(F.col(z).isNotNull()).select(*by, "row", "col", F.col(z).cast("double").alias("_z"))
    size = own.groupBy(*by).agg(F.count("*").alias("n"))
    own = written(own.join(size.filter(F.col("n") >= least).select(*by), keys, "left_semi"), "plane-points")
    plane = lambda df: instances.fit_plane(df, by, "_z").select(*by, "a", "b", "c")
    off = F.col("_z") - F.col("a") * F.col("col") - F.col("b") * F.col("row") - F.col("c")
    first = written(plane(own), "planes")
    gaps = own.join(first, keys).select(*by, "row", "col", "_z", off.alias("_r"))
    middle = gaps.groupBy(*by).agg(F.median("_r").alias("_m"))
    mad = gaps.join(middle, keys).groupBy(*by).agg(F.median(F.abs(F.col("_r") - F.col("_m"))).alias("_mad"))
    judged = written(gaps.join(mad, keys).select(*by, "row", "col", "_z", (F.abs("_r") <= F.greatest(F.lit(tolerance), 3 * F.col("_mad"))).alias("_k")), "judged")
    again = judged.groupBy(*by).agg(F.count_if("_k").alias("_n"), F.count("*").alias("_all")).filter((F.col("_n") >= least) & (F.col("_n") < F.col("_all")))
    second = plane(judged.filter("_k").join(again.select(*by), keys, "left_semi")).select(*by, *(F.col(c).alias(f"_{c}") for c in "abc"))
    line = first.join(second, keys, "left").select(*by, *(F.coalesce(f"_{c}", c).alias(c) for c in "abc"))
    fit = own.join(line, keys).groupBy(*by, "a", "b", "c").agg(F.avg((F.abs(off) <= tolerance).cast("double")).alias("inlier"), F.sqrt(F.avg(off * off)).alias("rmse"))
    return size.join(fit, keys, "left").na.fill(0.0, ["inlier"])


def choose_roof(points: DataFrame, by: tuple[str, ...] = ("scene_id", "mask_id"), z: str = "z", planes: bool = False) -> DataFrame:
    """Per roof: mode (platform, plane or measured), median height, deviation, pitch and share of inliers; with ``planes`` also the line z = a col + b row + c.

    A plane is fitted, fitted again without points off it by more than the larger of 0.6 m and
    three median deviations (if 8 points or more are left), and taken only where it explains the
    roof clearly better than its median and the roof rises across its footprint.
    """
    # Tolerances in metres, share of inliers, and how much better a plane must be.
    flat_tol, plane_tol, inlier_share, gain, least_pitch, residual_tol, scatter = 0.8, 0.6, 0.55, 0.70, 1.5, 1.5, 4.0
    keys = list(by)
    # Points and what each round finds are written, so that no later step goes back to the raster.
    own = written(points.filter(F.col(z).isNotNull()).select(*by, "row", "col", z), "roof-points")
    level = own.groupBy(*by).agg(F.median(z).alias("median"), F.count("*").alias("n"), (F.max("col") - F.min("col")).alias("wide"), (F.max("row") - F.min("row")).alias("high"))
    plane = lambda df: instances.fit_plane(df, by, z).select(*by, "a", "b", "c")
    off = F.col(z) - F.col("a") * F.col("col") - F.col("b") * F.col("row") - F.col("c")
    fitted = written(plane(own), "planes")
    first = own.join(fitted, keys).withColumn("_r", off)
    mid = first.groupBy(*by).agg(F.median("_r").alias("_m"))
    first = first.join(mid, keys)
    mad = first.groupBy(*by).agg(F.median(F.abs(F.col("_r") - F.col("_m"))).alias("_mad"))
    keep = F.abs("_r") <= F.greatest(F.lit(plane_tol), 3 * F.col("_mad"))
    judged = written(first.join(mad, keys).select(*by, "row", "col", z, keep.alias("_k")), "judged")
    enough = judged.groupBy(*by).agg(F.count_if("_k").alias("_n")).filter(F.col("_n") >= 8)
    second = plane(judged.filter("_k").join(enough.select(*by), keys, "left_semi")).select(*by, *(F.col(c).alias(f"_{c}") for c in "abc"))
    line = fitted.join(second, keys, "left").select(*by, *(F.coalesce(f"_{c}", c).alias(c) for c in "abc"))
    met = own.join(level, keys).join(line, keys, "left").withColumn("_r", off).withColumn("_f", F.col(z) - F.col("median"))
    out = met.groupBy(*by, "n", "median", "wide", "high", "a", "b", "c").agg(
        F.sqrt(F.avg(F.col("_f") * F.col("_f"))).alias("flat"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("tilt"), F.avg((F.abs("_r") <= plane_tol).cast("double")).alias("inlier")
    )
    pitch = F.coalesce(F.abs("a") * F.col("wide") + F.abs("b") * F.col("high"), F.lit(0.0))
    tilted = (F.col("inlier") >= inlier_share) & (pitch >= least_pitch) & (F.col("tilt") <= gain * F.col("flat")) & (F.col("tilt") <= residual_tol)
    mode = F.when(F.col("n") < 8, "measured").when(F.col("flat") <= flat_tol, "platform").when(tilted, "plane").when(F.col("flat") <= scatter, "platform").otherwise("measured")
    return out.withColumn("mode", mode).select(*by, "n", "mode", F.col("median").alias("platform_m"), F.when(F.col("mode") == "plane", F.col("tilt")).otherwise(F.col("flat")).alias("rmse_m"), pitch.alias("pitch_m"), F.coalesce("inlier", F.lit(0.0)).alias("inlier"), *(["a", "b", "c"] if planes else []))


#: Fixed values of snapping: how far an outline may move and the filter's radius, in pixels, and its regularisation.
SNAP_BAND, SNAP_RADIUS, SNAP_EPS = 3, 4, 1e-4


def filled_holes(mask_px: DataFrame) -> DataFrame:
    """scene_id, mask_id, row, col of masks with their holes: pixels outside that no 4-connected way leads from to the rim of the mask's box grown by one."""
    keys = ["scene_id", "mask_id"]
    own = mask_px.select(*keys, "row", "col").distinct()
    box = own.groupBy(*keys).agg(*(f(c).alias(f"_{k}_{c}") for c in ("row", "col") for k, f in (("lo", F.min), ("hi", F.max))))
    grid = box.withColumn("row", F.explode(F.sequence(F.col("_lo_row") - 1, F.col("_hi_row") + 1))).withColumn("col", F.explode(F.sequence(F.col("_lo_col") - 1, F.col("_hi_col") + 1)))
    outside = written(grid.join(own, [*keys, "row", "col"], "left_anti"), "outside")
    parts = graph.labelled_runs(outside, "mask_id")
    rim = (F.col("row") < F.col("_lo_row")) | (F.col("row") > F.col("_hi_row")) | (F.col("col") < F.col("_lo_col")) | (F.col("col") > F.col("_hi_col"))
    met = parts.join(box, keys)
    open_ = met.filter(rim).select(*keys, "component").distinct()
    return own.unionByName(met.join(open_, [*keys, "component"], "left_anti").select(*keys, "row", "col"))


def snap_footprint(mask_px: DataFrame, px: DataFrame, guide: str, h: int, w: int, band: int = SNAP_BAND, radius: int = SNAP_RADIUS, eps: float = SNAP_EPS) -> DataFrame:
    """scene_id, mask_id, row, col of masks whose outlines moved onto the edges of ``guide`` (luminance in 0 to 1; null: 0), by at most ``band`` pixels.

    Each mask is smoothed as 0 and 1 by a filter guided by the image; in the band around its
    outline, pixels of at least a half are in, others out. Then the largest 4-connected part stays
    (ties: the one that starts first) and holes are filled. A mask that would vanish, or that
    covers its scene, stays as it is. Masks overlap freely: each is filtered in the window of its
    box, wide enough that what lies outside can't change the band.
    """
    keys, at = ["scene_id", "mask_id"], ["scene_id", "mask_id", "row", "col"]
    own = written(mask_px.select(*at).distinct(), "snap-masks")
    size = own.groupBy(*keys).agg(F.count("*").alias("n"), *(f(c).alias(f"_{k}_{c}") for c in ("row", "col") for k, f in (("lo", F.min), ("hi", F.max))))
    # The band's coefficients need two boxes around each pixel.
    reach = band + 2 * radius
    for c, most in (("row", h - 1), ("col", w - 1)):
        size = size.withColumn(f"_a_{c}", F.greatest(F.col(f"_lo_{c}") - reach, F.lit(0))).withColumn(f"_b_{c}", F.least(F.col(f"_hi_{c}") + reach, F.lit(most)))
    some = size.filter(F.col("n") < h * w)
    grid = some.withColumn("row", F.explode(F.sequence("_a_row", "_b_row"))).withColumn("col", F.explode(F.sequence("_a_col", "_b_col"))).select(*at)
    light = px.select("scene_id", "row", "col", F.coalesce(F.col(guide).cast("double"), F.lit(0.0)).alias("_light"))
    dense = grid.join(light, list(PIXEL), "left").na.fill(0.0, ["_light"]).join(own.withColumn("_in", F.lit(True)), at, "left")
    dense = dense.withColumn("_in", F.coalesce("_in", F.lit(False)))
    soft = guided_windows(dense, radius, eps)
    # Outside the raster counts as not in the mask.
    near = instances.grown(own, "mask_id", band).withColumn("_near", F.lit(True))
    core = instances.shrunk(own, "mask_id", band).withColumn("_core", F.lit(True))
    out = soft.join(near, at, "left").join(core, at, "left")
    inside = F.when(F.col("_near") & F.col("_core").isNull(), F.col("_soft") >= 0.5).otherwise(F.col("_in"))
    snapped = written(out.filter(inside).select(*at), "snapped")
    parts = graph.labelled_runs(snapped, "mask_id")
    best = parts.groupBy(*keys, "component").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    whole = filled_holes(parts.join(best, [*keys, "component"], "left_semi"))
    return whole.unionByName(own.join(best, keys, "left_anti"))


def guided_windows(dense: DataFrame, radius: int, eps: float) -> DataFrame:
    """``dense`` (rectangles of pixels by scene and mask, ``_in`` and ``_light``) with ``_soft``: the mask smoothed with the edges of the light kept; windows are cut and padded at the rectangle's edges."""

    def boxes(df: DataFrame, cols: list[str]) -> DataFrame:
        for across, along in (("row", "col"), ("col", "row")):
            line = W.partitionBy("scene_id", "mask_id", across)
            frame = line.orderBy(along).rowsBetween(-radius, radius)
            place, last = F.col(along) - F.min(along).over(line), F.max(along).over(line) - F.col(along)
            # Beyond an edge its own value repeats.
            before, after = F.greatest(radius - place, F.lit(0)), F.greatest(radius - last, F.lit(0))
            df = df.withColumn("_before", before).withColumn("_after", after)
            ends = line.orderBy(along).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            mean = lambda c: (F.sum(c).over(frame) + F.col("_before") * F.first(c).over(ends) + F.col("_after") * F.last(c).over(ends)) / (2 * radius + 1)  # noqa: E731, B023
            df = df.withColumns({c: mean(c) for c in cols}).drop("_before", "_after")
        return df

    s, g = F.col("_in").cast("double"), F.col("_light")
    out = boxes(dense.withColumns({"_s": s, "_g": g, "_gs": g * s, "_gg": g * g}), ["_s", "_g", "_gs", "_gg"])
    a = (F.col("_gs") - F.col("_g") * F.col("_s")) / (F.col("_gg") - F.col("_g") * F.col("_g") + eps)
    out = boxes(out.withColumn("_a", a).withColumn("_b", F.col("_s") - F.col("_a") * F.col("_g")), ["_a", "_b"])
    return out.withColumn("_soft", F.col("_a") * g + F.col("_b")).select("scene_id", "mask_id", "row", "col", "_in", "_soft")
