"""Tiles, chips and delivery reports of rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions import encode
from rasterloom.operators import focal
from rasterloom.session import spread


def cut_tiles(px: DataFrame, v: str, h: int, w: int, tile: int = 512, pad: int = 1) -> DataFrame:
    """scene_id, tr, tc, y0, x0, h, w and ``data``: the tile's pixels in row order, with ``pad`` pixels around, the raster's edge repeated beyond it.

    Every pixel goes to each tile whose padded window holds it, so a tile is one group of bounded size.
    """

    def homes(axis: str, size: int):
        """The tiles along an axis whose padded window holds a pixel."""
        first, last = F.floor((F.col(axis) - pad) / tile), F.floor((F.col(axis) + pad) / tile)
        return F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit((size - 1) // tile)).cast("int"))

    rows = px.select("scene_id", "row", "col", F.col(v).alias("v"), F.explode(homes("row", h)).alias("tr"), homes("col", w).alias("_c"))
    rows = rows.select("scene_id", "row", "col", "v", "tr", F.explode("_c").alias("tc"))
    top, left = F.col("tr") * tile, F.col("tc") * tile
    bottom, right = F.least(top + tile, F.lit(h)), F.least(left + tile, F.lit(w))

    def repeats(axis: str, low, high, size: int):
        """Places along an axis that a pixel fills: its own, and the padding outside the raster for pixels of the edge."""
        at = F.col(axis)
        before = F.when((at == 0) & (low == 0), F.sequence(F.lit(-pad), F.lit(0))).otherwise(F.array(at))
        return F.when((at == size - 1) & (high == size), F.array_union(before, F.sequence(F.lit(size - 1), F.lit(size - 1 + pad)))).otherwise(before)

    rows = rows.withColumn("y", F.explode(repeats("row", top, bottom, h))).withColumn("x", F.explode(repeats("col", left, right, w)))
    inside = F.col("y").between(top - pad, bottom - 1 + pad) & F.col("x").between(left - pad, right - 1 + pad)
    groups = rows.filter(inside).groupBy("scene_id", "tr", "tc").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("cells"))
    return groups.select("scene_id", "tr", "tc", top.alias("y0"), left.alias("x0"), (bottom - top).alias("h"), (right - left).alias("w"), F.transform("cells", lambda c: c["v"]).alias("data"))


def reassemble(tiles: DataFrame, pad: int = 1) -> DataFrame:
    """scene_id, row, col, v: the interiors of ``cut_tiles``, which cover each pixel once."""
    wide = F.col("w") + 2 * pad
    cells = tiles.select("scene_id", "y0", "x0", "h", "w", F.posexplode("data").alias("k", "v"))
    i, j = F.floor(F.col("k") / wide).cast("int") - pad, (F.col("k") % wide).cast("int") - pad
    inside = i.between(0, F.col("h") - 1) & j.between(0, F.col("w") - 1)
    return cells.filter(inside).select("scene_id", (F.col("y0") + i).alias("row"), (F.col("x0") + j).alias("col"), "v")


def chip_grid(scenes: DataFrame, chip: int = 1024, overlap: float = 0.25) -> DataFrame:
    """scene_id, r, c: chip corners of scenes with ``h`` and ``w``, which always reach the last edge and never repeat."""
    step = max(1, int(chip * (1 - overlap)))

    def offsets(size: str):
        total = F.col(size)
        most = F.greatest(total - chip, F.lit(0)).cast("int")
        return F.array_union(F.sequence(F.lit(0), most, F.lit(step)), F.array(most))

    rows = scenes.select("scene_id", F.explode(offsets("h")).alias("r"), offsets("w").alias("_c"))
    return rows.select("scene_id", "r", F.explode("_c").alias("c"))


def overlap_pairs(chip_px: DataFrame) -> DataFrame:
    """scene_id, row, col, chip_a < chip_b and both values, for pixels that two chips share; a pixel lies in few chips."""
    cells = chip_px.groupBy("scene_id", "row", "col").agg(F.sort_array(F.collect_list(F.struct("chip", "v"))).alias("o")).filter(F.size("o") > 1)
    first = cells.select("scene_id", "row", "col", "o", F.posexplode("o").alias("k", "a"))
    pairs = first.select("scene_id", "row", "col", "a", F.explode(F.slice("o", F.col("k") + 2, F.size("o"))).alias("b"))
    return pairs.select("scene_id", "row", "col", F.col("a.chip").alias("chip_a"), F.col("b.chip").alias("chip_b"), F.col("a.v").alias("va"), F.col("b.v").alias("vb"))


def payload_report(tiles: DataFrame, size: str = "bytes") -> DataFrame:
    """Bytes by layer, by level of detail, by both, and in all (nulls mark what is summed over)."""
    return tiles.cube("layer", "lod").agg(F.sum(size).alias("bytes"), F.count("*").alias("n_tiles"))


def quantisation_sweep(px: DataFrame, layers: list[str], bits: tuple[int, ...] = (24, 16, 12, 8), by: str = "scene_id", sigma: str | None = None) -> DataFrame:
    """Per scene, layer and bit depth: step, worst error, error over span (and over the scene's mean ``sigma``), codes in use, and the cheapest depth within a thousandth of the span.

    Ranges come from one aggregation (a row per scene); all depths are scored in one pass. Codes
    rise with values, so those in use are counted where they change along a layer's values, which
    are sorted within 256 parts of its range; the ends of the parts are compared after that.
    """
    spans = [F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"_s_{c}") for c in layers]
    mean = F.avg(sigma) if sigma else F.lit(None).cast("double")
    met = px.select(by, *dict.fromkeys(layers)).join(px.groupBy(by).agg(*spans, mean.alias("sigma_m")), by)
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("layer"), F.col(c).cast("double").alias("v"), f"_s_{c}.lo", f"_s_{c}.hi") for c in layers)))
    rows = met.select(by, "sigma_m", one.alias("l")).filter("l.v is not null").select(by, "sigma_m", "l.*")
    share = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    rows = spread(rows.withColumn("_k", F.least(F.floor(share * 256), F.lit(255)).cast("int")), by, "layer", "_k")
    rows = rows.withColumn("_p", F.lag("v").over(W.partitionBy(by, "layer", "_k").orderBy("v")))
    code = lambda c, n: encode.unpack24(*encode.encode_linear_bits(F.col(c), F.col("lo"), F.col("hi"), n))
    sums = []
    for n in bits:
        low, high = encode.linear_range_for_bits(F.col("lo"), F.col("hi"), n)
        rgb = encode.encode_linear_bits(F.col("v"), F.col("lo"), F.col("hi"), n)
        sums += [F.max(F.abs(encode.decode_linear(*rgb, low, high) - F.col("v"))).alias(f"_w{n}"), F.count_if(F.col("_p").isNotNull() & (code("v", n) != code("_p", n))).alias(f"_n{n}")]
    keys = [by, "layer", "lo", "hi", "sigma_m"]
    parts = rows.groupBy(*keys, "_k").agg(F.min("v").alias("_first"), F.max("v").alias("_last"), *sums)
    parts = parts.withColumn("_before", F.lag("_last").over(W.partitionBy(by, "layer").orderBy("_k")))
    ends = {n: F.when(F.col("_before").isNull() | (code("_first", n) != code("_before", n)), 1).otherwise(0) for n in bits}
    whole = parts.groupBy(*keys).agg(*(F.struct(F.lit(n).alias("bits"), F.max(f"_w{n}").alias("worst"), F.sum(F.col(f"_n{n}") + ends[n]).alias("n_codes")).alias(f"_b{n}") for n in bits))
    span = F.col("hi") - F.col("lo")
    fine = [F.when(F.col(f"_b{n}.worst") <= 0.001 * span, F.lit(n)) for n in sorted(bits)]
    cases = F.array(*(F.struct(f"_b{n}.*", encode.linear_step(F.col("lo"), F.col("hi"), n).alias("step")) for n in bits))
    out = whole.select(by, "layer", span.alias("span"), "sigma_m", F.coalesce(*fine).alias("cheapest"), F.explode(cases).alias("q"))
    ratios = [F.try_divide("q.worst", "span").alias("worst_share")] + ([F.try_divide("q.worst", "sigma_m").alias("worst_sigmas")] if sigma else [])
    return out.select(by, "layer", "q.bits", "q.step", "q.worst", *ratios, "q.n_codes", "cheapest")


def roundtrip_report(px: DataFrame, layers: list[str], levels: int, h: int, w: int) -> DataFrame:
    """scene_id, lod, layer, the largest error of each coding after decoding, and whether both stay within half a step."""
    long = focal.pyramid(px, levels, h, w).unpivot(["scene_id", "lod"], layers, "layer", "v").filter(F.col("v").isNotNull())
    ends = long.groupBy("scene_id", "layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    met = long.join(ends, ["scene_id", "layer"])
    terrain = F.abs(encode.decode_terrain_rgb(*encode.encode_terrain_rgb(v)) - v)
    linear = F.abs(encode.decode_linear(*encode.encode_linear(v, lo, hi), lo, encode.widened(lo, hi)) - v)
    out = met.groupBy("scene_id", "lod", "layer", "lo", "hi").agg(F.max(terrain).alias("terrain_error"), F.max(linear).alias("linear_error"))
    fine = (F.col("terrain_error") <= encode.STEP_M / 2 + 1e-6) & (F.col("linear_error") <= (encode.widened(lo, hi) - lo) / encode.MAX_CODE / 2 + 1e-6)
    return out.withColumn("within", fine).drop("lo", "hi")
