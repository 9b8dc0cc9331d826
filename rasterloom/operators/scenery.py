"""What a picture tells without a model: shadows, the runs that buildings cast, prominence, land cover, and how masks and meshes keep apart."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions import encode, geo
from rasterloom.operators import focal, footprints, graph, instances, ranks, scores, solids, surfaces
from rasterloom.session import written_pixels

KEYS = ["scene_id", "row", "col"]
#: Class codes of land cover.
BARE, ROAD, BUILDING, VEGETATION, WATER = 0, 1, 2, 3, 4


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 0..255 bands in thousandths of a step, a whole number."""
    return (299 * r.cast("long") + 587 * g.cast("long") + 114 * b.cast("long")).cast("long")


def shadow_index(px: DataFrame, name: str = "shadow_index") -> DataFrame:
    """Adds blue against the stronger of red and green, scaled over the scene, in the dark. One row a scene is joined back."""
    hue = F.atan2(F.col("b") / 255.0, F.greatest(F.col("r") / 255.0, F.col("g") / 255.0, F.lit(1e-6)))
    own = px.withColumn("_hue", hue)
    span = own.groupBy("scene_id").agg(F.min("_hue").alias("_lo"), F.max("_hue").alias("_hi"))
    share = (F.col("_hue") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    lum = encode.spectral_channels(F.col("r"), F.col("g"), F.col("b"))["lum"]
    return own.join(span, "scene_id").withColumn(name, share * (1 - lum)).drop("_hue", "_lo", "_hi")


def detect_shadow(px: DataFrame, h: int, w: int, water: int | None = WATER, least: int = 30, dark: float = 0.30, most: float = 0.35) -> DataFrame:
    """scene_id, row, col of cast shadows on a dense grid with r, g, b and ``sem``.

    A shadow is blue (index above Otsu's threshold) and dark (luminance below its ``dark``
    quantile), and isn't water. Where that is more than ``most`` of a scene, only pixels under
    that quantile of luminance stay. The mask is opened and closed, and components of under
    ``least`` pixels go. Pixels without colour are none.
    """
    own = shadow_index(px.select(*KEYS, "r", "g", "b", "sem"), "_i").withColumn("_l", luminance(F.col("r"), F.col("g"), F.col("b")))
    cut = scores.otsu(own, "_i").select("scene_id", F.col("threshold").alias("_t"))
    q = ranks.exact_quantiles(own, "_l", (dark, most), ("scene_id",)).select("scene_id", F.col("q").alias("_q"))
    met = own.join(cut, "scene_id", "left").join(q, "scene_id", "left")
    wet = F.coalesce(F.col("sem") == water, F.lit(False)) if water is not None else F.lit(False)
    met = met.withColumn("_m", F.coalesce((F.col("_i") > F.col("_t")) & (F.col("_l") < F.col("_q")[0]), F.lit(False)) & ~wet)
    share = met.groupBy("scene_id").agg(F.avg(F.col("_m").cast("int")).alias("_s"))
    met = met.join(share, "scene_id").withColumn("_m", F.col("_m") & ((F.col("_s") <= most) | (F.col("_l") < F.col("_q")[1])))
    out = focal.closed(focal.opened(met.select(*KEYS, "_m"), "_m", 1, "_o"), "_o", 2, "_c")
    return graph.connected_components(out.filter("_c"), w, least).select(*KEYS)


def segment_heuristic(px: DataFrame, h: int, w: int, ndsm: str | None = None, shadow: str | None = None, tall: float = 2.5, name: str = "cover") -> DataFrame:
    """Adds a class to each pixel of a dense grid with r, g, b: bare ground, vegetation, water, road or building.

    Green comes first; water is blue and smooth; roads are grey, darker and smooth; buildings
    stand over ``tall`` metres (column ``ndsm``) or, without heights, are bright and rough. Water
    and buildings are opened and closed, roads opened. Where ``shadow`` holds, the median class
    around is taken. Pixels without colour count as black.
    """
    band = lambda c: F.coalesce(F.col(c), F.lit(0))
    ch = encode.spectral_channels(band("r"), band("g"), band("b"))
    own = px.withColumns({"_e": ch["exg"], "_x": ch["exb"], "_s": ch["sat"], "_lum": ch["lum"], "_l": luminance(band("r"), band("g"), band("b"))})
    own = focal.roughness(own, "_lum", h, w, 7, "_t").withColumn("_t", F.round("_t", 9))

    def with_quantiles(df: DataFrame, value: str, where: Column, parts: list[float], to: str) -> DataFrame:
        q = ranks.exact_quantiles(df.filter(where), value, tuple(parts), ("scene_id",))
        return df.join(q.select("scene_id", F.col("q").alias(to)), "scene_id", "left")

    own = with_quantiles(own, "_t", F.lit(True), [0.35, 0.45, 0.55], "_tq").withColumn("_veg", F.col("_e") > 0.06)
    own = own.withColumn("_w", (F.col("_x") > 0.05) & (F.col("_t") < F.col("_tq")[0]) & ~F.col("_veg"))
    own = focal.closed(focal.opened(own, "_w", 2, "_wo"), "_wo", 4, "_water").drop("_wo")
    own = own.withColumn("_open", ~F.col("_veg") & ~F.col("_water"))
    own = with_quantiles(own, "_l", F.col("_open"), [0.55, 0.78], "_lq")
    road = F.col("_open") & (F.col("_s") < 0.20) & (F.col("_l") < F.col("_lq")[0]) & (F.col("_t") < F.col("_tq")[1])
    own = focal.opened(own.withColumn("_r", F.coalesce(road, F.lit(False))), "_r", 1, "_road")
    if ndsm is not None:
        built = (F.col(ndsm) > tall) & ~F.col("_water") & ~F.col("_veg")
    else:
        built = F.col("_open") & (F.col("_l") > F.col("_lq")[1]) & (F.col("_t") > F.col("_tq")[2])
    own = own.withColumn("_b", F.coalesce(built, F.lit(False)))
    own = focal.closed(focal.opened(own, "_b", 1, "_bo"), "_bo", 2, "_built")
    # The later class wins.
    cover = F.when(F.col("_built"), BUILDING).when(F.col("_road"), ROAD).when(F.col("_water"), WATER).when(F.col("_veg"), VEGETATION).otherwise(BARE)
    own = own.withColumn(name, cover).select(*px.columns, name)
    if shadow is None:
        return own
    return surfaces.median_fill(own, name, shadow, (BARE, ROAD, BUILDING, VEGETATION, WATER), h, w, 9, "_fill").withColumn(name, F.col("_fill")).drop("_fill")


def anti_solar(azimuth: float) -> tuple[float, float]:
    """The step (row, col) of length one away from the sun."""
    a = math.radians(azimuth)
    return math.cos(a), -math.sin(a)


#: Steps of the first round of a walk along shadows; each later round is twice as long.
FIRST_STEPS = 8


def shadow_runs(blobs: DataFrame, buildings: DataFrame, shadow: DataFrame, azimuth: float, h: int, w: int, steps: int, gap: int = 2) -> DataFrame:
    """scene_id, component, row, col and ``length`` of the run of shadow that each pixel on the shaded side of a building casts.

    The walk goes away from the sun, pixel by pixel, up to ``steps``; it ends at a building, at
    the raster's edge, or after more than ``gap`` lit pixels. Lit pixels between dark ones count.
    ``blobs`` are labelled building pixels, ``buildings`` and ``shadow`` pixel sets. Walks go in
    rounds that double, and only those that haven't ended go on; no exploded walk is broadcast.
    """
    d_row, d_col = anti_solar(azimuth)
    keys = ["scene_id", "component", "row", "col"]
    place = lambda c, d, k: F.rint(F.col(c) + d * k).cast("int")
    inside = lambda c, size: F.least(F.greatest(c, F.lit(0)), F.lit(size - 1))
    at = lambda df, stop: df.select("scene_id", F.col("row").alias("_y"), F.col("col").alias("_x"), F.lit(stop).alias("_stop"))
    marks = written_pixels(at(buildings, True).unionByName(at(shadow, False)).groupBy("scene_id", "_y", "_x").agg(F.max("_stop").alias("_stop")), "marks")
    ahead = blobs.select(*keys, inside(place("row", d_row, F.lit(1)), h).alias("_y"), inside(place("col", d_col, F.lit(1)), w).alias("_x"))
    edge = ahead.join(marks.filter("_stop"), ["scene_id", "_y", "_x"], "left_anti")
    live = written_pixels(edge.select(*keys, F.lit(0).alias("length")), "shaded")
    done, far, size = [], 0, FIRST_STEPS
    while True:
        upto = min(far + size, steps)
        walk = live.select(*keys, F.explode(F.sequence(F.lit(far + 1), F.lit(upto))).alias("k")) if upto > far else live.select(*keys, F.lit(1).alias("k")).limit(0)
        walk = walk.withColumns({"_y": place("row", d_row, F.col("k")), "_x": place("col", d_col, F.col("k"))}).filter(F.col("_y").between(0, h - 1) & F.col("_x").between(0, w - 1))
        hits = walk.join(marks, ["scene_id", "_y", "_x"]).select(*keys, "k", "_stop").unionByName(live, allowMissingColumns=True)
        met = hits.groupBy(*keys).agg(F.max("length").alias("_last"), F.min(F.when(F.col("_stop"), F.col("k"))).alias("_end"), F.sort_array(F.collect_list(F.when(~F.col("_stop"), F.col("k")))).alias("_dark"))
        before = F.filter("_dark", lambda k: k < F.coalesce(F.col("_end"), F.lit(steps + 1)))
        length = F.aggregate(before, F.col("_last"), lambda last, k: F.when(k - last - 1 <= gap, k).otherwise(last))
        goes_on = F.col("_end").isNull() & (upto - F.col("length") <= gap)
        now = written_pixels(met.withColumn("length", length).select(*keys, "length", goes_on.alias("_live")), "walks")
        live, far, size = now.filter("_live").select(*keys, "length"), upto, 2 * size
        if far >= steps or live.isEmpty():
            done.append(now.select(*keys, "length"))
            return functools.reduce(DataFrame.unionByName, done)
        done.append(now.filter("not _live").select(*keys, "length"))


def harvest_shadow(
    blobs: DataFrame, buildings: DataFrame, shadow: DataFrame, azimuth: float, elevation: float, gsd: float, h: int, w: int,
    scale: float = 1.0, heights: tuple[float, float] = (2.0, 400.0), gap: int = 2, ring: int = 12,
) -> DataFrame:
    """Relative anchors, one for each building with four runs of shadow or more.

    The height is the median run times pixel size and tangent of the sun's elevation; the weight
    falls with the sun's quality gate, with runs that disagree, and with other buildings near.
    Heights outside ``heights`` and weights of 0.02 or less are left out. Row and col are the
    centroid; ref_row and ref_col lie two steps before the middle run's pixel.
    """
    tan = math.tan(math.radians(elevation))
    steps = int(min(max(h, w), heights[1] / max(tan, 1e-6) / max(gsd, 1e-6)))
    d_row, d_col = anti_solar(azimuth)
    blobs = written_pixels(blobs.select("scene_id", "component", "row", "col"), "blobs")
    runs = shadow_runs(blobs, buildings, shadow, azimuth, h, w, steps, gap).filter("length >= 2")
    keys = ["scene_id", "component"]
    mid = runs.groupBy(*keys).agg(F.median("length").alias("_len"), F.count("*").alias("n_runs"), F.sort_array(F.collect_list(F.struct("row", "col"))).alias("_at"))
    mad = runs.join(mid.select(*keys, "_len"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("length") - F.col("_len"))).alias("_mad"))
    shape = blobs.groupBy(*keys).agg(F.rint(F.avg("row")).cast("int").alias("row"), F.rint(F.avg("col")).cast("int").alias("col"))
    out = mid.filter("n_runs >= 4").join(mad, keys).join(shape, keys).join(footprints.isolation_score(blobs, h, w, ring), keys)
    crisp = F.least(F.greatest(1 - F.col("_mad") / F.greatest("_len", F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    weight = F.least(F.greatest(geo.sun_quality_gate(F.lit(float(elevation))) * crisp * F.col("isolation") * scale, F.lit(0.0)), F.lit(1.0))
    at = F.get("_at", F.floor(F.col("n_runs") / 2).cast("int"))
    clip = lambda c, size: F.least(F.greatest(F.rint(c).cast("int"), F.lit(0)), F.lit(size - 1))
    out = out.select(*keys, "row", "col", (F.col("_len") * gsd * tan).alias("height_m"), weight.alias("weight"), "n_runs",
                     clip(at["row"] + 2 * d_row, h).alias("ref_row"), clip(at["col"] + 2 * d_col, w).alias("ref_col"))
    return out.filter(F.col("height_m").between(*heights) & (F.col("weight") > 0.02))


def prominence(px: DataFrame, v: str, h: int, w: int, size: int = 200, tile: int = 64, name: str = "prominence") -> DataFrame:
    """scene_id, row, col and ``v`` less the tenth percentile of the size x size window around (mirrored edges).

    The percentile is the value of rank size^2 // 10. A task holds one tile and its halo.
    """
    before, after, rank = size // 2, (size - 1) // 2, size * size // 10
    halo = max(before, after)
    own = px.select(*KEYS, F.col(v).cast("double").alias("v"))
    for axis, length in (("row", h), ("col", w)):
        own = focal.mirrored(own, axis, length, halo)
        first = F.greatest(F.floor((F.col(axis) - halo) / tile), F.lit(0))
        last = F.least(F.floor((F.col(axis) + halo) / tile), F.lit((length - 1) // tile))
        own = own.withColumn(f"t_{axis}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))

    def low(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        grid[pdf["row"] - r0, pdf["col"] - c0] = pdf["v"]
        rows, cols = (pdf["row"], h), (pdf["col"], w)
        inside = (pdf["row"] // tile == pdf["t_row"]) & (pdf["col"] // tile == pdf["t_col"]) & rows[0].between(0, rows[1] - 1) & cols[0].between(0, cols[1] - 1)
        mine = pdf[inside].sort_values(["row", "col"])
        out = np.empty(len(mine))
        # One window at a time: no more than size^2 values are held.
        for k, (r, c) in enumerate(zip(mine["row"] - r0, mine["col"] - c0, strict=True)):
            window = grid[r - before : r + after + 1, c - before : c + after + 1].ravel()
            out[k] = np.partition(window, rank)[rank]
        return pd.DataFrame({"scene_id": mine["scene_id"], "row": mine["row"], "col": mine["col"], name: mine["v"].to_numpy() - out})

    kinds = ", ".join(f"{c} {px.schema[c].dataType.simpleString()}" for c in KEYS)
    return own.groupBy("scene_id", "t_row", "t_col").applyInPandas(low, f"{kinds}, {name} double")


def slope_mae(px: DataFrame, pred: str, ref: str, gsd: float = 1.0, by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Mean absolute difference of the slopes of two surfaces, degrees."""
    both = focal.slope_deg(focal.slope_deg(px, pred, gsd, "_sp"), ref, gsd, "_sr")
    return both.groupBy(*by).agg(F.avg(F.abs(F.col("_sp") - F.col("_sr"))).alias("slope_mae_deg"))


def stability_score(px: DataFrame, logit: str, by: tuple[str, ...] = ("scene_id", "mask_id"), offset: float = 1.0) -> DataFrame:
    """Area where the logit passes ``offset`` over the area where it passes -``offset`` (at least 1)."""
    return px.groupBy(*by).agg((F.count_if(F.col(logit) > offset) / F.greatest(F.count_if(F.col(logit) > -offset), F.lit(1))).alias("stability"))


def outline_lines(mask_px: DataFrame, key: str = "mask_id") -> DataFrame:
    """scene_id, key, row and ``cols``: the pixels of each mask whose 3 x 3 box isn't all in it, as lines. Lines of the mask move, not pixels."""
    rows = mask_px.groupBy("scene_id", key, "row").agg(F.collect_set("col").alias("_c"))
    order = W.partitionBy("scene_id", key).orderBy("row")
    beside = lambda at, step: F.coalesce(F.when(at("row").over(order) == F.col("row") + step, at("_c").over(order)), F.array().cast("array<int>"))
    rows = rows.select("scene_id", key, "row", "_c", F.array_intersect(F.array_intersect("_c", beside(F.lag, -1)), beside(F.lead, 1)).alias("_three"))
    east, west = F.transform("_three", lambda x: x + 1), F.transform("_three", lambda x: x - 1)
    return rows.select("scene_id", key, "row", F.array_except("_c", F.array_intersect(F.array_intersect("_three", east), west)).alias("cols"))


def boundary_f1(a: DataFrame, b: DataFrame, tol: float = 2.0, key: str = "mask_id") -> DataFrame:
    """Per key F1 of two outlines: the shares of each that lie within ``tol`` pixels of the other. 0 where one is missing.

    Lines of both outlines are put in order, and each meets the lines within ``tol`` above and below.
    """
    line, r = ["scene_id", key, "row"], int(tol)
    wide = [max(x for x in range(r + 1) if y * y + x * x <= tol * tol) for y in range(r + 1)]
    none = F.array().cast("array<int>")
    both = outline_lines(a, key).withColumnRenamed("cols", "_a").unionByName(outline_lines(b, key).withColumnRenamed("cols", "_b"), allowMissingColumns=True)
    both = both.groupBy(*line).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("_a", "_b")))
    order = W.partitionBy("scene_id", key).orderBy("row")
    steps = [(F.lag, k) for k in range(1, r + 1)] + [(F.lead, k) for k in range(1, r + 1)]
    met = both.select(*line, "_a", "_b", *(F.abs(f("row", k).over(order) - F.col("row")).alias(f"_d{i}") for i, (f, k) in enumerate(steps)), *(f(c, k).over(order).alias(f"{c}{i}") for i, (f, k) in enumerate(steps) for c in ("_a", "_b")))

    def moved(cols: Column, k: int) -> Column:
        return F.transform(cols, lambda c: c + k)

    def hits(own: str, other: str) -> Column:
        """Pixels of a line within ``tol`` of the other outline: columns are moved by each way that a line so far off allows."""
        near = []
        for y, x in enumerate(wide):
            lines = [F.col(other)] if y == 0 else [F.when(F.col(f"_d{i}") == y, F.col(f"{other}{i}")).otherwise(none) for i in range(len(steps))]
            at = lines[0] if y == 0 else F.concat(*lines)
            near += [at] + [moved(at, k) for k in range(-x, x + 1) if k]
        return F.sum(F.size(F.array_intersect(own, F.concat(*near))))

    sums = met.groupBy("scene_id", key).agg(hits("_a", "_b").alias("_ha"), F.sum(F.size("_a")).alias("_ca"), hits("_b", "_a").alias("_hb"), F.sum(F.size("_b")).alias("_cb"))
    p, q = (F.coalesce(F.try_divide(h, c), F.lit(0.0)) for h, c in (("_ha", "_ca"), ("_hb", "_cb")))
    return sums.select("scene_id", key, F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0).alias("boundary_f1"))


def separation(v: DataFrame, f: DataFrame, labels: DataFrame, group: str = "grp") -> DataFrame:
    """Per scene: groups of faces, share of groups that are a component of their own, vertices that groups share, and a score.

    ``labels`` gives scene_id, vid and label of connected vertices; vertices without one are
    components of their own. A vertex of k groups counts k - 1 times; any shared vertex halves
    the score.
    """
    named = v.select("scene_id", "vid").join(labels, ["scene_id", "vid"], "left").withColumn("label", F.coalesce("label", "vid"))
    size = named.groupBy("scene_id", "label").agg(F.count("*").alias("_size"))
    used = f.filter(F.col(group).isNotNull()).select("scene_id", group, F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    per = used.join(named, ["scene_id", "vid"]).groupBy("scene_id", group).agg(F.count("*").alias("_n"), F.min("label").alias("label"), F.max("label").alias("_max"))
    own = per.join(size, ["scene_id", "label"]).withColumn("_own", ((F.col("label") == F.col("_max")) & (F.col("_n") == F.col("_size"))).cast("int"))
    shared = used.groupBy("scene_id", "vid").agg((F.count("*") - 1).alias("_k")).groupBy("scene_id").agg(F.sum("_k").alias("shared_vertices"))
    out = own.groupBy("scene_id").agg(F.count("*").alias("buildings"), F.avg("_own").alias("own_component")).join(shared, "scene_id")
    return out.withColumn("separation_score", F.col("own_component") * F.when(F.col("shared_vertices") == 0, 1.0).otherwise(0.5))


def adaptive_blocks(px: DataFrame, z: str, h: int, w: int, tol: float = 0.35, block: int = 8) -> DataFrame:
    """scene_id, br, bc, ``fine`` (the surface through the corners misses a pixel by more than ``tol``) and whether the blocks above, below, left and right are fine."""
    err = focal.block_error(px, z, h, w, block)
    own = err.select("scene_id", "br", "bc", (F.round("error", 6) > tol).alias("fine"))
    across, along = W.partitionBy("scene_id", "br").orderBy("bc"), W.partitionBy("scene_id", "bc").orderBy("br")
    near = {"up": F.lag("fine").over(along), "down": F.lead("fine").over(along), "left": F.lag("fine").over(across), "right": F.lead("fine").over(across)}
    return own.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in near.items()})


def adaptive_vertices(blocks: DataFrame, h: int, w: int, block: int = 8) -> DataFrame:
    """scene_id, row, col of the vertices of an adaptive mesh: all of fine blocks; of others the corners, the centre, and the edges that face a fine block."""
    r0, c0 = F.col("br") * block, F.col("bc") * block
    own = blocks.withColumns({"r0": r0, "c0": c0, "r1": F.least(r0 + block, F.lit(h - 1)), "c1": F.least(c0 + block, F.lit(w - 1))})
    own = own.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    top, bottom, first, last = F.col("row") == F.col("r0"), F.col("row") == F.col("r1"), F.col("col") == F.col("c0"), F.col("col") == F.col("c1")
    centre = (F.col("row") == F.floor((F.col("r0") + F.col("r1")) / 2)) & (F.col("col") == F.floor((F.col("c0") + F.col("c1")) / 2))
    edges = (top & F.col("up")) | (bottom & F.col("down")) | (first & F.col("left")) | (last & F.col("right"))
    return own.filter(F.col("fine") | ((top | bottom) & (first | last)) | centre | edges).select(*KEYS).distinct()


def collect_samples(inventory: DataFrame, px: DataFrame, pos: str, ndsm: str) -> tuple[DataFrame, DataFrame]:
    """(samples, skipped): scenes that a scale can be learned from, and the others with the first reason against them.

    ``inventory`` has scene_id, depth and reference (paths or null), reference_kind, dtm (path or
    null), and the sizes of depth and truth. A sample has its target, the error of heights at it,
    and that of no heights at all.
    """
    goal = scores.scene_target(px, pos, ndsm)
    reason = (
        F.when(F.col("depth").isNull(), "no relative depth")
        .when(F.col("reference").isNull(), "no reference")
        .when(~F.col("reference_kind").eqNullSafe("ndsm") & F.col("dtm").isNull(), "elevation without bare earth")
        .when(~F.col("depth_size").eqNullSafe(F.col("truth_size")), "grid mismatch")
        .when(F.col("target").isNull(), "empty high band")
    )
    judged = inventory.join(goal, "scene_id", "left").withColumn("reason", reason)
    good = judged.filter("reason is null").select("scene_id", "target", "n_px")
    p, t = F.greatest(F.col("target") * F.col(pos), F.lit(0.0)), F.col(ndsm)
    errors = px.join(good, "scene_id").groupBy("scene_id", "target", "n_px").agg(F.avg(F.abs(p - t)).alias("ndsm_mae_at_target"), F.avg(F.abs(t)).alias("floor_mae"))
    return errors, judged.filter("reason is not null").select("scene_id", "reason")


def select_buildings(pixels: DataFrame, px: DataFrame, height: str, h: int, w: int, least: int = 40) -> DataFrame:
    """Buildings among instances: each instance's cells without pinches, parted into 4-connected pieces, measured, and numbered by instance and piece where nothing refuses them.

    ``pixels`` is scene_id, row, col, instance (one a pixel). A piece's pixels are the corners of
    its cells. Returns scene_id, building, instance and the measures of ``zonal_measure``.
    """
    # Instances lie one below the other, an empty row between, so that pieces of two never touch.
    step = F.lit(h + 1).cast("long")
    cells = solids.unpinch(footprints.to_cells(pixels, "instance"), "instance").select("scene_id", (F.col("instance") * step + F.col("row")).alias("row"), "col")
    part = graph.connected_components(cells, w)
    row = (F.col("row") % step).cast("int")
    corners = F.array(*(F.struct((row + i).alias("row"), (F.col("col") + j).alias("col")) for i in (0, 1) for j in (0, 1)))
    own = part.select("scene_id", F.floor(F.col("row") / step).cast("int").alias("instance"), F.col("component").alias("mask_id"), F.explode(corners).alias("p"))
    own = written_pixels(own.select("scene_id", "instance", "mask_id", "p.row", "p.col").distinct(), "pieces")
    large = own.groupBy("scene_id", "instance", "mask_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("scene_id", "instance", "mask_id")
    kept = own.join(large, ["scene_id", "instance", "mask_id"], "left_semi")
    px = written_pixels(px.select("scene_id", "row", "col", "sem", height), "heights")
    measured = instances.zonal_measure(kept.drop("instance"), px, height).filter("refused is null").drop("refused", "n_roof", "outlier_share", "note")
    order = W.partitionBy("scene_id").orderBy("instance", "mask_id")
    return measured.join(large, ["scene_id", "mask_id"]).withColumn("building", F.row_number().over(order)).drop("mask_id")
