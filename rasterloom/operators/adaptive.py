"""Adaptive sheets: fans over coarse blocks that meet fine ones without cracks, and the tolerance a triangle budget allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators import focal, scenery
from rasterloom.session import written_pixels as written

#: Tolerances in metres that are tried in turn, and how often block sizes double.
LADDER, SIZES = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 9.0, 14.0, 20.0), 4


def _bounds(blocks: DataFrame, h: int, w: int, block) -> DataFrame:
    r0, c0 = F.col("br") * block, F.col("bc") * block
    return blocks.withColumns({"r0": r0.cast("int"), "c0": c0.cast("int"), "r1": F.least(r0 + block, F.lit(h - 1)).cast("int"), "c1": F.least(c0 + block, F.lit(w - 1)).cast("int")})


def adaptive_triangles(blocks: DataFrame, vertices: DataFrame, h: int, w: int, block: int = 8) -> DataFrame:
    """scene_id, a, b, c: triangles (vertex ids are places in row order) of ``scenery.adaptive_blocks`` over ``scenery.adaptive_vertices``.

    A fine block has two triangles a cell. A coarse one is a fan from its centre to each side of
    its ring, which holds just the vertices that live, so it meets its neighbours without a crack.
    Fans whose centre lies on the ring (blocks one pixel wide) lose the two triangles that would
    name it twice; their others on that side stand upright. A task holds the ring of one block.
    """
    own = _bounds(blocks, h, w, block)
    at = lambda row, col: row.cast("long") * w + col
    cells = own.filter("fine").select("scene_id", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1").select("scene_id", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"))
    r, c = F.col("r"), F.col("c")
    tl, tr, bl, br = at(r, c), at(r, c + 1), at(r + 1, c), at(r + 1, c + 1)
    two = F.array(*(F.struct(*(x.alias(n) for n, x in zip("abc", t, strict=True))) for t in ((bl, br, tr), (bl, tr, tl))))
    fine = cells.select("scene_id", F.explode(two).alias("t")).select("scene_id", "t.*")
    spot = lambda row, col: F.struct(row.alias("row"), col.alias("col"))
    r0, c0, r1, c1 = (F.col(x) for x in ("r0", "c0", "r1", "c1"))
    down = F.lit(-1)
    ring = F.concat(
        F.transform(F.sequence(c0, c1 - 1), lambda x: spot(r1, x)), F.transform(F.sequence(r1, r0 + 1, down), lambda x: spot(x, c1)),
        F.transform(F.sequence(c1, c0 + 1, down), lambda x: spot(r0, x)), F.transform(F.sequence(r0, r1 - 1), lambda x: spot(x, c0)),
    )
    centre = at(F.floor((r0 + r1) / 2), F.floor((c0 + c1) / 2)).alias("centre")
    rings = own.filter("not fine").select("scene_id", "br", "bc", centre, F.posexplode(ring).alias("k", "p")).select("scene_id", "br", "bc", "centre", "k", "p.row", "p.col")
    live = rings.join(vertices.select("scene_id", "row", "col"), ["scene_id", "row", "col"], "left_semi").withColumn("a", at(F.col("row"), F.col("col")))
    whole = W.partitionBy("scene_id", "br", "bc").orderBy("k")
    fans = live.select("scene_id", "a", F.coalesce(F.lead("a").over(whole), F.first("a").over(whole)).alias("b"), F.col("centre").alias("c"))
    return fine.unionByName(fans.filter((F.col("a") != F.col("c")) & (F.col("b") != F.col("c"))))


def count_triangles(errors: DataFrame, tolerances: DataFrame, h: int, w: int) -> DataFrame:
    """scene_id, size, tolerance and the number of triangles of ``adaptive_triangles``, from block errors (scene_id, size, br, bc, error) alone.

    A coarse block has four sides to its ring, one more for each vertex between the corners of a
    side that a fine neighbour (or the middle of a neighbour one pixel wide) needs.
    """
    keys = ["scene_id", "size", "tolerance"]
    own = errors.join(tolerances, ["scene_id", "size"]).withColumn("fine", F.round("error", 6) > F.col("tolerance"))
    across, along = W.partitionBy(*keys, "br").orderBy("bc"), W.partitionBy(*keys, "bc").orderBy("br")
    near = {"up": F.lag("fine").over(along), "down": F.lead("fine").over(along), "left": F.lag("fine").over(across), "right": F.lead("fine").over(across)}
    own = _bounds(own.withColumns(near), h, w, F.col("size")).withColumns({"dr": F.col("r1") - F.col("r0"), "dc": F.col("c1") - F.col("c0")})
    dr, dc, needs = F.col("dr"), F.col("dc"), lambda side: F.coalesce(F.col(side), F.lit(False))
    last_r = (F.col("r1") + 1 == h - 1) & (F.col("r1") - F.col("r0") == F.col("size"))
    last_c = (F.col("c1") + 1 == w - 1) & (F.col("c1") - F.col("c0") == F.col("size"))
    n = lambda where, k: F.when(where, k).otherwise(0)
    sides = n(needs("up"), dc - 1) + n(needs("down"), dc - 1) + n(needs("left"), dr - 1) + n(needs("right"), dr - 1)
    middle = n((dr == 1) & (dc > 1) & ~needs("up"), 1) + n((dc == 1) & (dr > 1) & ~needs("left"), 1) - n((dr == 1) | (dc == 1), 2)
    beside = n(last_r & ~needs("down") & (dc > 1), 1) + n(last_c & ~needs("right") & (dr > 1), 1)
    total = F.when(F.col("fine"), 2 * dr * dc).otherwise(4 + sides + middle + beside)
    return own.groupBy(*keys).agg(F.sum(total).cast("long").alias("n_triangles"))


def tolerance_for_budget(px: DataFrame, z: str, h: int, w: int, most: int, block: int = 8, floor: float = 0.25) -> DataFrame:
    """scene_id, size, tolerance, n_triangles and whether they are within ``most``: the tightest tolerance that a budget of triangles allows.

    All rungs of tolerances and all block sizes (doubled up to three times) are counted in one pass
    over the errors of blocks; the first that fits, by size and then tolerance, is drawn tighter by
    four halvings towards the rung before it. Where none fits, the one of fewest triangles is told.
    """
    sizes = [s for s in (block * 2**k for k in range(SIZES)) if min(h, w) >= s + 1]
    if not sizes:
        raise ValueError(f"a raster of {h} x {w} is smaller than a block of {block}")
    parts = [focal.block_error(px, z, h, w, s).withColumn("size", F.lit(s)) for s in sizes]
    errors = parts[0]
    for p in parts[1:]:
        errors = errors.unionByName(p)
    errors = written(errors, "block-errors")
    rungs = [floor, *(t for t in LADDER if t > floor)]
    every = errors.select("scene_id", "size").distinct().withColumn("tolerance", F.explode(F.array(*map(F.lit, rungs))))
    counted = count_triangles(errors, every, h, w)
    fit = F.min(F.when(F.col("n_triangles") <= most, F.struct("size", "tolerance", "n_triangles")))
    chosen = counted.groupBy("scene_id").agg(fit.alias("fit"), F.min(F.struct("n_triangles", "size", "tolerance")).alias("least"))
    best, fits = F.coalesce("fit.tolerance", "least.tolerance"), F.col("fit").isNotNull()
    before = F.array_max(F.filter(F.array(*map(F.lit, rungs)), lambda t: t < best))
    now = written(chosen.select("scene_id", F.coalesce("fit.size", "least.size").alias("size"), best.alias("best"), F.coalesce("fit.n_triangles", "least.n_triangles").alias("n"), fits.alias("fits"), F.when(fits, before).alias("low")), "budget")
    for _ in range(4):
        mid = now.filter("low is not null").select("scene_id", "size", ((F.col("low") + F.col("best")) / 2).alias("tolerance"))
        met = now.join(count_triangles(errors, mid, h, w), ["scene_id", "size"], "left")
        fine = F.coalesce(F.col("n_triangles") <= most, F.lit(False))
        now = written(met.select("scene_id", "size", F.when(fine, F.col("tolerance")).otherwise(F.col("best")).alias("best"), F.when(fine, F.col("n_triangles")).otherwise(F.col("n")).alias("n"), "fits", F.when(fine, F.col("low")).otherwise(F.col("tolerance")).alias("low")), "budget")
    return now.select("scene_id", "size", F.col("best").alias("tolerance"), F.col("n").alias("n_triangles"), "fits")
