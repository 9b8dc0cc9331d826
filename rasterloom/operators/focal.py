"""Neighbourhood operators over dense pixel tables, as separable windows along rows and columns.

A window is partitioned by scene and row (or column), never by scene, so its rows are bounded by
the width of a raster. The grid is dense: each scene has every (row, col) of its rectangle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators import ranks

def along_row():
    return W.partitionBy("scene_id", "row").orderBy("col")


def along_col():
    return W.partitionBy("scene_id", "col").orderBy("row")


def _difference(v: str, w, gsd: float) -> Column:
    """Central difference; one-sided at both ends."""
    before, after, here = F.lag(v).over(w), F.lead(v).over(w), F.col(v)
    return F.when(before.isNull(), (after - here) / gsd).when(after.isNull(), (here - before) / gsd).otherwise((after - before) / (2 * gsd))


def gradient(px: DataFrame, v: str = "z", gsd: float = 1.0, names: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """Adds the derivative along columns (east) and along rows (south)."""
    return px.withColumn(names[0], _difference(v, along_row(), gsd)).withColumn(names[1], _difference(v, along_col(), gsd))


def slope_deg(px: DataFrame, v: str = "z", gsd: float = 1.0, name: str = "slope") -> DataFrame:
    out = gradient(px, v, gsd, ("_gx", "_gy"))
    return out.withColumn(name, F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))).drop("_gx", "_gy")


def aspect_deg(px: DataFrame, v: str = "z", gsd: float = 1.0, name: str = "aspect") -> DataFrame:
    """Downslope direction, degrees clockwise from north."""
    out = gradient(px, v, gsd, ("_gx", "_gy"))
    return out.withColumn(name, F.pmod(F.degrees(F.atan2(-F.col("_gx"), F.col("_gy"))) + 360, F.lit(360.0))).drop("_gx", "_gy")


def mirrored(px: DataFrame, axis: str, size: int, radius: int, edge: str = "reflect") -> DataFrame:
    """Adds ``radius`` rows beyond both ends of an axis: mirrored, the edge doubled (``reflect``), or the edge itself (``nearest``)."""
    at = F.col(axis)
    if edge == "reflect":
        near, far = F.when(at < radius, -1 - at), F.when(at >= size - radius, 2 * size - 1 - at)
        places = F.array_compact(F.array(at, near, far))
    else:
        ends = F.sequence(F.lit(-radius), F.lit(-1)), F.sequence(F.lit(size), F.lit(size + radius - 1))
        places = F.when(at == 0, F.concat(F.array(at), ends[0])).when(at == size - 1, F.concat(F.array(at), ends[1])).otherwise(F.array(at))
    return px.withColumn(axis, F.explode(places))


def _inside(px: DataFrame, axis: str, size: int) -> DataFrame:
    return px.filter(F.col(axis).between(0, size - 1))


def box_mean(px: DataFrame, v: str, radius: int, h: int, w: int, name: str = "mean", edge: str = "reflect") -> DataFrame:
    """Adds the mean over the (2 radius + 1)^2 box; the axes one after the other."""
    out = px.withColumn(name, F.col(v))
    for axis, size, along in (("col", w, along_row()), ("row", h, along_col())):
        padded = mirrored(out, axis, size, radius, edge)
        out = _inside(padded.withColumn(name, F.avg(name).over(along.rowsBetween(-radius, radius))), axis, size)
    return out


def roughness(px: DataFrame, v: str, h: int, w: int, win: int = 9, name: str = "roughness") -> DataFrame:
    """Local deviation from the local mean: the root of the box mean of squared differences to the box mean."""
    out = box_mean(px, v, win // 2, h, w, "_m").withColumn("_d", F.pow(F.col(v) - F.col("_m"), F.lit(2)))
    out = box_mean(out, "_d", win // 2, h, w, "_q")
    return out.withColumn(name, F.sqrt(F.greatest(F.col("_q"), F.lit(0.0)))).drop("_m", "_d", "_q")


def gaussian(px: DataFrame, v: str, sigma: float, h: int, w: int, name: str = "low") -> DataFrame:
    """Adds the Gaussian mean (kernel cut at four sigma, mirrored edges), as one weighted sum of shifted values an axis."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [x / sum(weights) for x in weights]
    out = px.withColumn(name, F.col(v))
    for axis, size, along in (("col", w, along_row()), ("row", h, along_col())):
        padded = mirrored(out, axis, size, radius)
        total = F.lit(0.0)
        for k, x in zip(range(-radius, radius + 1), weights, strict=True):
            total = total + F.lag(name, k).over(along) * F.lit(x) if k else total + F.col(name) * F.lit(x)
        out = _inside(padded.withColumn("_s", total), axis, size).drop(name).withColumnRenamed("_s", name)
    return out


def tri(px: DataFrame, v: str, h: int, w: int, name: str = "tri") -> DataFrame:
    """Mean absolute difference to the eight neighbours; the raster wraps around at its edges."""
    # A pixel goes to its line and the two beside it; there, windows by place look left and right and skip no gap.
    lines = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.pmod(F.col("row") + k, F.lit(h)).cast("int").alias("row")) for k in (-1, 0, 1)))).alias("s")
    sent = px.select("scene_id", lines, "col", v).select("scene_id", "s.row", "col", "s.k", v).repartition("scene_id", "row")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col(v)))
    met = sent.groupBy("scene_id", "row", "col").agg(F.max(F.col("k") == 0).alias("_own"), F.array(at(1), at(0), at(-1)).alias("_t"))
    side = lambda k: F.when(F.col("col") == (w - 1 if k > 0 else 0), F.first("_t").over(along_row().rangeBetween(k * (1 - w), k * (1 - w)))).otherwise(F.first("_t").over(along_row().rangeBetween(k, k)))
    met = met.select("*", F.get("_t", 1).alias(v), side(-1).alias("_a"), side(1).alias("_b")).filter("_own")
    gaps = [F.coalesce(F.abs(F.get(c, i) - F.col(v)), F.lit(0.0)) for c in ("_a", "_t", "_b") for i in range(3) if (c, i) != ("_t", 1)]
    return met.select("scene_id", "row", "col", v, F.when(F.col(v).isNotNull(), sum(gaps[1:], gaps[0]) / 8).alias(name))


def dilate(px: DataFrame, mask: str, radius: int, name: str) -> DataFrame:
    """Whether any pixel of the (2 radius + 1)^2 box is set; outside counts as unset."""
    out = px.withColumn(name, F.coalesce(F.col(mask), F.lit(False)).cast("int"))
    for along in (along_row(), along_col()):
        out = out.withColumn(name, F.max(name).over(along.rowsBetween(-radius, radius)))
    return out.withColumn(name, F.col(name) == 1)


def erode(px: DataFrame, mask: str, radius: int, name: str) -> DataFrame:
    """Whether all pixels of the box are set; outside counts as unset, so edges go."""
    out = px.withColumn(name, F.coalesce(F.col(mask), F.lit(False)).cast("int"))
    for along in (along_row(), along_col()):
        frame = along.rowsBetween(-radius, radius)
        full = F.count(F.lit(1)).over(frame) == 2 * radius + 1
        out = out.withColumn(name, F.when(full, F.min(name).over(frame)).otherwise(0))
    return out.withColumn(name, F.col(name) == 1)


def opened(px: DataFrame, mask: str, radius: int, name: str) -> DataFrame:
    return dilate(erode(px, mask, radius, "_e"), "_e", radius, name).drop("_e")


def closed(px: DataFrame, mask: str, radius: int, name: str) -> DataFrame:
    return erode(dilate(px, mask, radius, "_d"), "_d", radius, name).drop("_d")


def boundaries(px: DataFrame, value: str, name: str = "boundary") -> DataFrame:
    """Whether one of the four neighbours holds another value (null counts as a value)."""
    differs = F.lit(False)
    for along in (along_row(), along_col()):
        for shift in (F.lag, F.lead):
            other = shift(F.struct(value)).over(along)
            differs = differs | (other.isNotNull() & ~other[value].eqNullSafe(F.col(value)))
    return px.withColumn(name, differs)


def edge_f1(px: DataFrame, pred: str, ref: str, gsd: float = 1.0, tolerance: int = 2, pct: float = 0.92) -> DataFrame:
    """F1 per scene of height edges (gradient above its 92nd percentile) with a tolerance box; null without edges or under 100 values."""
    out = gradient(gradient(px, pred, gsd, ("_px", "_py")), ref, gsd, ("_rx", "_ry"))
    for side, x, y in (("_p", "_px", "_py"), ("_r", "_rx", "_ry")):
        out = out.withColumn(side, F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    sides = ("_p", "_r")
    cut = ranks.exact_quantiles(out.select("scene_id", *sides).unpivot(["scene_id"], list(sides), "side", "v"), "v", (pct,), ("scene_id", "side")).filter("n >= 100")
    cut = cut.groupBy("scene_id").agg(*(F.max(F.when(F.col("side") == c, F.col("q")[0])).alias(f"{c}_cut") for c in sides))
    out = out.join(cut, "scene_id", "left")
    for c in ("_p", "_r"):
        out = dilate(out.withColumn(f"{c}e", F.coalesce(F.col(c) > F.col(f"{c}_cut"), F.lit(False))), f"{c}e", tolerance, f"{c}d")
    n = out.groupBy("scene_id").agg(
        F.count_if("_pe").alias("np"), F.count_if("_re").alias("nr"),
        F.count_if(F.col("_pe") & F.col("_rd")).alias("hp"), F.count_if(F.col("_re") & F.col("_pd")).alias("hr"),
    )
    precision, recall = F.try_divide("hp", "np"), F.try_divide("hr", "nr")
    f1 = F.when((F.col("np") > 0) & (F.col("nr") > 0), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    return n.select("scene_id", f1.alias("edge_f1"), F.col("np").alias("n_pred_edges"), F.col("nr").alias("n_ref_edges"))


def rank_normalise(df: DataFrame, v: str, by: tuple[str, ...], name: str = "rank01") -> DataFrame:
    """Average-tie rank from 0 to 1 within a group; null gives 0, a constant or single value 0.5."""
    span = df.groupBy(*by).agg(F.count(v).alias("_all"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    out = ranks.average_ranks(df, v, by, "_r").alias("a").join(span.alias("b"), on).select("a.*", "_all", "_lo", "_hi")
    rank = F.when(F.col(v).isNull(), 0.0).when(F.col("_lo") == F.col("_hi"), 0.5).otherwise((F.col("_r") - 1) / (F.col("_all") - 1))
    return out.withColumn(name, rank).drop("_r", "_all", "_lo", "_hi")


def pyramid(px: DataFrame, levels: int, h: int, w: int) -> DataFrame:
    """Every level of detail that keeps at least two pixels a side: pixels at multiples of 2^lod, without averaging."""
    lods = [k for k in range(levels) if min(-(-h // 2**k), -(-w // 2**k)) >= 2]
    fits = [F.when((F.col("row") % 2**k == 0) & (F.col("col") % 2**k == 0), F.lit(k)) for k in lods]
    out = px.withColumn("lod", F.explode(F.array_compact(F.array(*fits))))
    return out.withColumns({axis: F.expr(f"shiftright({axis}, lod)") for axis in ("row", "col")})


def block_error(px: DataFrame, z: str, h: int, w: int, block: int = 8) -> DataFrame:
    """Per block, the largest distance between a pixel and the bilinear surface through the block's corners; borders belong to both sides."""

    def spans(axis: str, size: int) -> Column:
        last = (size - 2) // block
        own = F.least(F.floor(F.col(axis) / block), F.lit(last)).cast("int")
        shared = F.when((F.col(axis) % block == 0) & (F.col(axis) > 0) & (own * block == F.col(axis)), own - 1)
        return F.array_compact(F.array(own, shared))

    cells = px.withColumn("br", F.explode(spans("row", h))).withColumn("bc", F.explode(spans("col", w))).withColumnRenamed(z, "z")
    top, left = F.col("br") * block, F.col("bc") * block
    bottom, right = F.least(top + block, F.lit(h - 1)), F.least(left + block, F.lit(w - 1))
    corner = {
        k: F.max(F.when((F.col("row") == y) & (F.col("col") == x), F.col("z")))
        for k, y, x in (("nw", top, left), ("ne", top, right), ("sw", bottom, left), ("se", bottom, right))
    }
    ends = cells.groupBy("scene_id", "br", "bc").agg(*(c.alias(k) for k, c in corner.items()))
    u, v = (F.col("row") - top) / (bottom - top), (F.col("col") - left) / (right - left)
    plane = (1 - u) * ((1 - v) * F.col("nw") + v * F.col("ne")) + u * ((1 - v) * F.col("sw") + v * F.col("se"))
    return cells.join(ends, ["scene_id", "br", "bc"]).groupBy("scene_id", "br", "bc").agg(F.max(F.abs(F.col("z") - plane)).alias("error"))
