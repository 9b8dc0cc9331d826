"""Operators that make surfaces of surfaces: calibrated heights, guided smoothing, shadows, class filters and chip predictors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import focal, joins, ranks
from rasterloom.session import written_pixels

KEYS = ("scene_id", "row", "col")


def apply_calibration(px: DataFrame, depth: str = "d", high: str | None = None, name: str = "height_m") -> DataFrame:
    """Adds a x depth + b; a dual-branch field uses its own high band, never the raw depth."""
    return px.withColumn(name, F.col("a") * F.col(high or depth) + F.col("b"))


def downscale(px: DataFrame, v: str, h: int, w: int, most: int) -> DataFrame:
    """scene_id, row, col, v of every scene brought to at most ``most`` pixels a side, bilinear at pixel centres; smaller scenes stay."""
    factor = max(1.0, max(h, w) / most)
    rows, cols = max(1, round(h / factor)), max(1, round(w / factor))
    line = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = px.select("scene_id").distinct().select("scene_id", line(rows).alias("to_row")).select("scene_id", "to_row", line(cols).alias("to_col"))
    at = lambda c: (F.col(c) + 0.5) * factor - 0.5
    points = grid.select("*", at("to_row").alias("y"), at("to_col").alias("x"))
    out = joins.bilinear_at(px, points, v, h, w, v)
    return out.select("scene_id", F.col("to_row").alias("row"), F.col("to_col").alias("col"), v)


def downscale_scenes(scenes: DataFrame, h: int, w: int, most: int) -> DataFrame:
    """``scenes`` with the pixel terms of their transform times the factor of ``downscale``; the origin stays."""
    factor = max(1.0, max(h, w) / most)
    own = F.transform("transform", lambda x, i: F.when(i % 3 == 2, x).otherwise(x * factor))
    return scenes.withColumn("transform", own)


def guided_filter(px: DataFrame, src: str, guide: str, radius: int, eps: float, h: int, w: int, name: str = "guided") -> DataFrame:
    """Adds ``src`` smoothed with the edges of ``guide`` kept: local lines src = a guide + b over boxes, their coefficients averaged."""

    def boxes(df: DataFrame, cols: list[str]) -> DataFrame:
        # All means of an axis share one exchange.
        for axis, size, along in (("col", w, focal.along_row()), ("row", h, focal.along_col())):
            frame = along.rowsBetween(-radius, radius)
            padded = focal.mirrored(df, axis, size, radius, "nearest")
            df = padded.withColumns({c: F.avg(c).over(frame) for c in cols}).filter(F.col(axis).between(0, size - 1))
        return df

    s, g = F.col(src), F.col(guide)
    out = boxes(px.withColumns({"_s": s.cast("double"), "_g": g.cast("double"), "_gs": g * s, "_gg": g * g}), ["_s", "_g", "_gs", "_gg"])
    a = (F.col("_gs") - F.col("_g") * F.col("_s")) / (F.col("_gg") - F.col("_g") * F.col("_g") + eps)
    out = out.withColumn("_a", a).withColumn("_b", F.col("_s") - F.col("_a") * F.col("_g"))
    out = boxes(out, ["_a", "_b"])
    return out.withColumn(name, F.col("_a") * g + F.col("_b")).drop("_s", "_g", "_gs", "_gg", "_a", "_b")


def refine_heights(
    px: DataFrame, height: str, guide: str, h: int, w: int, gsd: float, radius: float = 2.0, eps: float = 4e-3, clamp: float | None = None, preserve: float = 30.0
) -> DataFrame:
    """Adds ``refined``, heights above ground with the edges of ``guide`` (luminance in 0 to 1), and ``moved``, by how much each pixel changed.

    The mean over ``preserve`` metres is held: what is added is taken from there. No pixel moves by
    over ``clamp`` metres (a quarter of the scene's 99th percentile, to a millimetre, if not given)
    or under 0. Null heights count as 0.
    """
    own = px.withColumn("_z", F.coalesce(F.col(height), F.lit(0.0)))
    sharp = guided_filter(own, "_z", guide, max(1, round(radius / gsd)), eps, h, w, "_sharp").withColumn("_dz", F.col("_sharp") - F.col("_z"))
    held = focal.box_mean(sharp, "_dz", max(1, round(preserve / gsd)), h, w, "_mean", "nearest")
    if clamp is None:
        most = ranks.quantiles(own, "_z", (0.99,), ("scene_id",)).select("scene_id", (0.25 * F.col("q")[0]).alias("_most"))
        held = held.join(most, "scene_id")
    else:
        held = held.withColumn("_most", F.lit(float(clamp)))
    step = F.col("_dz") - F.col("_mean")
    bound = F.when(F.col("_most") > 0, F.least(F.greatest(step, -F.col("_most")), F.col("_most"))).otherwise(step)
    out = held.withColumn("refined", F.greatest(F.col("_z") + bound, F.lit(0.0)))
    return out.withColumn("moved", F.col("refined") - F.col("_z")).drop("_z", "_sharp", "_dz", "_mean", "_most")


def refine_stats(px: DataFrame, moved: str, by: tuple[str, ...] = ("scene_id",), least: float = 0.05) -> DataFrame:
    """Largest and root-mean-square residual, and the share of pixels that moved by more than ``least``."""
    m = F.col(moved)
    return px.groupBy(*by).agg(F.max(F.abs(m)).alias("max_abs_m"), F.sqrt(F.avg(m * m)).alias("rms_m"), F.avg((F.abs(m) > least).cast("double")).alias("moved_fraction"))


def median_fill(px: DataFrame, cls: str, where: str, classes: tuple[int, ...], h: int, w: int, size: int = 9, name: str = "filled") -> DataFrame:
    """Adds the median class of the size^2 box (mirrored edges) where ``where`` holds, else the class itself.

    The median of few classes follows from how often each occurs in the box, and counts are
    separable sums: two exchanges, whatever the size.
    """
    r, names = size // 2, [f"_c{k}" for k in classes]
    out = px.withColumns({n: (F.col(cls) == k).cast("int") for n, k in zip(names, classes, strict=True)})
    for axis, length, along in (("col", w, focal.along_row()), ("row", h, focal.along_col())):
        frame = along.rowsBetween(-r, r)
        out = focal.mirrored(out, axis, length, r).withColumns({n: F.sum(n).over(frame) for n in names}).filter(F.col(axis).between(0, length - 1))
    half, seen, median = size * size // 2 + 1, F.lit(0), F.lit(None).cast("int")
    for n, k in zip(names, sorted(classes), strict=True):
        seen = seen + F.col(n)
        median = F.coalesce(median, F.when(seen >= half, F.lit(k)))
    return out.withColumn(name, F.when(F.col(where), median).otherwise(F.col(cls))).drop(*names)


def cast_shadow(px: DataFrame, z: str, azimuth: float, elevation: float, gsd: float, h: int, w: int, steps: int = 96, tile: int = 256) -> DataFrame:
    """scene_id, row, col and whether the surface on the way to the sun (``steps`` pixels, bilinear, held at the edges) stands above the ray.

    Tiles come with a halo of ``steps`` pixels, so a task holds one tile whatever the raster.
    """
    el, az = math.radians(elevation), math.radians(azimuth)
    d_col, d_row, d_z = math.cos(el) * math.sin(az), -math.cos(el) * math.cos(az), math.sin(el)

    def homes(axis: str, size: int):
        first = F.greatest(F.floor((F.col(axis) - steps) / tile), F.lit(0))
        last = F.least(F.floor((F.col(axis) + steps) / tile), F.lit((size - 1) // tile))
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    cut = px.select(*KEYS, F.col(z).cast("double").alias("z"), homes("row", h).alias("ty")).withColumn("tx", homes("col", w))

    def march(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        grid[pdf["row"] - r0, pdf["col"] - c0] = pdf["z"]
        own = pdf[(pdf["row"] // tile == pdf["ty"]) & (pdf["col"] // tile == pdf["tx"])]
        row, col, at = own["row"].to_numpy(float), own["col"].to_numpy(float), own["z"].to_numpy()
        dark = np.zeros(len(own), bool)
        for k in range(1, steps + 1):
            y, x = np.clip(row + d_row * k, 0, h - 1), np.clip(col + d_col * k, 0, w - 1)
            yi, xi = np.minimum(np.floor(y), h - 2).astype(int), np.minimum(np.floor(x), w - 2).astype(int)
            fy, fx, i, j = y - yi, x - xi, yi - r0, xi - c0
            surf = (1 - fy) * ((1 - fx) * grid[i, j] + fx * grid[i, j + 1]) + fy * ((1 - fx) * grid[i + 1, j] + fx * grid[i + 1, j + 1])
            dark |= surf > at + d_z * k * gsd + 1e-3
        return pd.DataFrame({"scene_id": own["scene_id"], "row": own["row"], "col": own["col"], "shadow": dark})

    kinds = ", ".join(f"{c} {px.schema[c].dataType.simpleString()}" for c in KEYS)
    return cut.groupBy("scene_id", "ty", "tx").applyInPandas(march, f"{kinds}, shadow boolean")


def scene_features(px: DataFrame, depth: str, high: str, dem: str, gsd: float) -> DataFrame:
    """Per scene what a scale can be predicted from: p99 and deviation of the high band, range of the depth, pixel size, relief of the elevation model."""
    # Written once, because quantiles look at their values twice and each layer would bring the raster anew.
    px = written_pixels(px.select("scene_id", depth, high, dem), "features")
    layers = [depth, high, dem]
    spread = px.groupBy("scene_id").agg(F.stddev_pop(high).alias("hi_std"))
    found = ranks.quantiles(px.unpivot(["scene_id"], layers, "_layer", "_v"), "_v", (0.01, 0.99), ("scene_id", "_layer"))
    own = found.groupBy("scene_id").agg(*(F.max(F.when(F.col("_layer") == c, F.col("q"))).alias(f"q_{c}") for c in layers))
    out = spread.join(own, "scene_id").filter(F.col(f"q_{high}").isNotNull() & F.col(f"q_{depth}").isNotNull())
    return out.select(
        "scene_id", F.col(f"q_{high}")[1].alias("hi_p99"), "hi_std", (F.col(f"q_{depth}")[1] - F.col(f"q_{depth}")[0]).alias("rd_range"), F.lit(gsd).alias("gsd_m"),
        (F.col(f"q_{dem}")[1] - F.col(f"q_{dem}")[0]).alias("dem_relief_m"),
    )


def fitted_scale(features: DataFrame, model: DataFrame, backbone: str, radius: float) -> DataFrame:
    """scene_id, scale and why it is refused: another backbone, another radius, or a value that isn't positive. ``model`` has one row."""
    both = features.crossJoin(F.broadcast(model.limit(1)))
    value = F.col("intercept") + F.col("coef") * F.col("x")
    why = F.when(F.col("backbone") != backbone, "backbone").when(F.abs(F.col("radius_m") - radius) > 1e-9, "radius").when(value <= 0, "not positive")
    return both.select("scene_id", F.when(why.isNull(), value).alias("scale"), why.alias("refused"))


def overlap_affine(pairs: DataFrame, src: str, ref: str, weight: str, by: tuple[str, ...], rounds: int = 2, least: int = 16) -> DataFrame:
    """Per overlap the line ref = s src + t by weighted least squares, reweighted by Huber's rule at 1.4826 times the median residual.

    Overlaps of under ``least`` pixels keep (1, 0); a constant side keeps slope 1; slopes lie in
    0.05 to 20. Medians come from counts of residuals in steps of 1e-6.
    """
    rows = pairs.select(*by, F.col(src).cast("double").alias("_s"), F.col(ref).cast("double").alias("_r"), F.col(weight).cast("double").alias("_w"))
    line = None
    for k in range(rounds):
        w = F.col("_w")
        means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), (F.sum(w * F.col("_s")) / F.sum(w)).alias("ms"), (F.sum(w * F.col("_r")) / F.sum(w)).alias("mr"))
        ds, dr = F.col("_s") - F.col("ms"), F.col("_r") - F.col("mr")
        sums = rows.join(means, list(by)).groupBy(*by, "n", "sw", "ms", "mr").agg((F.sum(w * ds * ds) / F.first("sw")).alias("var"), (F.sum(w * ds * dr) / F.first("sw")).alias("cov"))
        slope = F.when(F.col("var") < 1e-8, 1.0).otherwise(F.col("cov") / F.col("var"))
        line = sums.withColumn("s", slope).withColumn("t", F.col("mr") - F.col("s") * F.col("ms")).select(*by, "n", "s", "t")
        if k + 1 < rounds:
            own = rows.join(line, list(by)).withColumn("_e", F.abs(F.col("s") * F.col("_s") + F.col("t") - F.col("_r")))
            cut = ranks.quantiles(own, "_e", (0.5,), by, step=1e-6, cells=1 << 16).select(*by, F.greatest(1.4826 * F.col("q")[0], F.lit(1e-4)).alias("_d"))
            rows = own.join(cut, list(by)).select(*by, "_s", "_r", (w * F.least(F.lit(1.0), F.col("_d") / F.greatest(F.col("_e"), F.lit(1e-12)))).alias("_w"))
    few = F.col("n") < least
    return line.select(*by, "n", F.when(few, 1.0).otherwise(F.least(F.greatest("s", F.lit(0.05)), F.lit(20.0))).alias("s"), F.when(few, 0.0).otherwise(F.col("t")).alias("t"))


def chip_apply(px: DataFrame, bands: tuple[str, ...], size: int, predict: Callable[[np.ndarray], np.ndarray], name: str = "depth") -> DataFrame:
    """Runs ``predict`` ((h, w, bands) to (h, w), higher is taller) on every chip of ``size`` pixels; another shape of result is an error.

    A chip of a ragged edge is smaller; pixels that aren't there are 0 to the predictor and stay absent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min() // size * size, pdf["col"].min() // size * size
        shape = (int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1)
        chip = np.zeros((*shape, len(bands)), np.uint8)
        chip[pdf["row"] - r0, pdf["col"] - c0] = pdf[list(bands)].to_numpy()
        out = np.asarray(predict(chip), float)
        if out.shape != shape:
            raise ValueError(f"the predictor gave {out.shape} for a chip of {shape}")
        return pdf[list(KEYS)].assign(**{name: out[pdf["row"] - r0, pdf["col"] - c0]})

    kinds = ", ".join(f"{c} {px.schema[c].dataType.simpleString()}" for c in KEYS)
    at = lambda c: F.expr(f"{c} div {size}")
    return px.groupBy("scene_id", at("row"), at("col")).applyInPandas(run, f"{kinds}, {name} double")
