"""Joins of pixels with anchors, lattices, points, polygons and lines, and robust fits over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.session import written_pixels as written


def sample_at(px: DataFrame, points: DataFrame, value: str, name: str) -> DataFrame:
    """``points`` with the value of their pixel; null outside."""
    return points.join(px.select("scene_id", "row", "col", F.col(value).alias(name)), ["scene_id", "row", "col"], "left")


def harvest_dem(px: DataFrame, height: str, admissible: tuple[int, ...], stride: int, steep: Column | None = None, weight: float = 0.6) -> DataFrame:
    """Anchors of the elevation model on the stride grid, where the class is ground, the height is there and the slope isn't steep."""
    grid = (F.col("row") % stride == 0) & (F.col("col") % stride == 0)
    fine = grid & F.col("sem").isin(*admissible) & F.col(height).isNotNull()
    if steep is not None:
        fine = fine & ~steep
    return px.filter(fine).select("scene_id", "row", "col", F.col(height).alias("value_m"), F.lit("dem").alias("source"), F.lit(weight).alias("weight"))


def lattice_nodes(row: Column, col: Column, stride: int, h: int, w: int) -> list[tuple[Column, Column, Column]]:
    """Row, column and bilinear weight of the four lattice nodes around a pixel; weights sum to 1 (nodes at the far edge coincide)."""
    rows, cols = -(-(h - 1) // stride), -(-(w - 1) // stride)
    y, x = row / stride, col / stride
    r0, c0 = F.least(F.floor(y), F.lit(rows - 1)).cast("int"), F.least(F.floor(x), F.lit(cols - 1)).cast("int")
    fy, fx = y - r0, x - c0
    return [(r0 + i, c0 + j, (fy if i else 1 - fy) * (fx if j else 1 - fx)) for i in (0, 1) for j in (0, 1)]


def lattice_weights(df: DataFrame, stride: int, h: int, w: int) -> DataFrame:
    """One row for each of ``lattice_nodes``."""
    nodes = [F.struct(r.alias("node_r"), c.alias("node_c"), v.alias("w")) for r, c, v in lattice_nodes(F.col("row"), F.col("col"), stride, h, w)]
    return df.withColumn("_n", F.explode(F.array(*nodes))).select(*df.columns, "_n.node_r", "_n.node_c", "_n.w")


def lattice_upsample(lattice: DataFrame, px: DataFrame, stride: int, h: int, w: int, values: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Node values at every pixel, bilinear. The lattice is smaller than the pixels by the square of the stride."""
    spread = lattice_weights(px.select("scene_id", "row", "col"), stride, h, w)
    joined = spread.hint("merge").join(lattice, ["scene_id", "node_r", "node_c"])  # exploded rows are no small table
    return joined.groupBy("scene_id", "row", "col").agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in values))


def bilinear_at(px: DataFrame, points: DataFrame, value: str, h: int, w: int, name: str) -> DataFrame:
    """``points`` (scene_id, y, x) with the bilinear value at real-valued places, held at the edges."""
    y, x = F.least(F.greatest(F.col("y"), F.lit(0.0)), F.lit(h - 1.0)), F.least(F.greatest(F.col("x"), F.lit(0.0)), F.lit(w - 1.0))
    r0, c0 = F.least(F.floor(y), F.lit(h - 2)).cast("int"), F.least(F.floor(x), F.lit(w - 2)).cast("int")
    corners = [
        F.struct((r0 + i).alias("row"), (c0 + j).alias("col"), (((y - r0) if i else 1 - (y - r0)) * ((x - c0) if j else 1 - (x - c0))).alias("w"))
        for i in (0, 1)
        for j in (0, 1)
    ]
    spread = points.withColumn("_c", F.explode(F.array(*corners))).select(*points.columns, "_c.row", "_c.col", "_c.w")
    joined = spread.join(px.select("scene_id", "row", "col", F.col(value).alias("_v")), ["scene_id", "row", "col"])
    return joined.groupBy(*points.columns).agg(F.sum(F.col("w") * F.col("_v")).alias(name))


def nearest_at(px: DataFrame, points: DataFrame, value: str, h: int, w: int, name: str) -> DataFrame:
    """``points`` (scene_id, y, x) with the value of the nearest pixel, halves to the even one, for classes that have no mean; null outside the raster."""
    inside = F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)
    at = points.withColumns({"_row": F.when(inside, F.rint("y").cast("int")), "_col": F.when(inside, F.rint("x").cast("int"))})
    own = px.select("scene_id", F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias(name))
    return at.join(own, ["scene_id", "_row", "_col"], "left").select(*points.columns, name)


def profile(px: DataFrame, lines: DataFrame, value: str, h: int, w: int, gsd: float = 1.0, n: int = 512) -> DataFrame:
    """``n`` samples along each line (line_id, scene_id, r0, c0, r1, c1): step, distance and bilinear value."""
    t = F.col("step") / (n - 1)
    length = F.sqrt(F.pow(F.col("r1") - F.col("r0"), F.lit(2)) + F.pow(F.col("c1") - F.col("c0"), F.lit(2)))
    points = lines.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "line_id", "scene_id", "step", (t * length * gsd).alias("distance_m"),
        (F.col("r0") + t * (F.col("r1") - F.col("r0"))).alias("y"), (F.col("c0") + t * (F.col("c1") - F.col("c0"))).alias("x"),
    )
    return bilinear_at(px, points, value, h, w, "elevation_m").select("line_id", "step", "distance_m", "elevation_m")


def ring_edges(polygons: DataFrame) -> DataFrame:
    """scene_id, feature_id and the two ends (y0, x0, y1, x1) of every side of ``pts``; rings close themselves."""
    corners = polygons.select("scene_id", "feature_id", F.size("pts").alias("n"), "pts", F.posexplode("pts").alias("k", "p"))
    nxt = F.get("pts", (F.col("k") + 1) % F.col("n"))
    return corners.select("scene_id", "feature_id", F.col("p.y").alias("y0"), F.col("p.x").alias("x0"), nxt["y"].alias("y1"), nxt["x"].alias("x1"))


def fill_polygon(polygons: DataFrame, h: int, w: int) -> DataFrame:
    """scene_id, feature_id, row, col of pixels whose centre (whole numbers) lies inside, by the even-odd rule.

    A side covers the rows from its lower end up to, not including, its upper end; between the
    1st and 2nd, 3rd and 4th crossing of a row pixels are inside. Every side gives its rows, so
    the join with rows is an explode, not a range join.
    """
    e = ring_edges(polygons)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.ceil(low), F.lit(0)), F.least(F.ceil(high) - 1, F.lit(h - 1))
    rows = e.filter(low < high).withColumns({"_f": first.cast("int"), "_l": last.cast("int")}).filter("_f <= _l")
    cross = rows.withColumn("row", F.explode(F.sequence("_f", "_l")))
    x = F.col("x0") + (F.col("row") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    order = W.partitionBy("scene_id", "feature_id", "row").orderBy("x")
    cross = cross.withColumn("x", x).select("scene_id", "feature_id", "row", "x", (F.row_number().over(order) - 1).alias("k"))
    pairs = cross.groupBy("scene_id", "feature_id", "row", F.expr("k div 2").alias("pair")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n"))
    start, stop = F.greatest(F.ceil("a"), F.lit(0)).cast("int"), F.least(F.floor("b"), F.lit(w - 1)).cast("int")
    spans = pairs.filter("n = 2").withColumns({"_a": start, "_b": stop}).filter("_a <= _b")
    return spans.select("scene_id", "feature_id", "row", F.explode(F.sequence("_a", "_b")).alias("col")).distinct()


def polygon_area(polygons: DataFrame) -> DataFrame:
    """scene_id, feature_id, area (shoelace) and dominant angle of the sides modulo 90 degrees, weighted by length."""
    e = ring_edges(polygons)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length, angle = F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx)
    sums = e.groupBy("scene_id", "feature_id").agg(
        (F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))) / 2).alias("area"),
        F.sum(length * F.sin(4 * angle)).alias("s"), F.sum(length * F.cos(4 * angle)).alias("c"),
    )
    turn = F.pmod(F.degrees(F.atan2("s", "c")) / 4 + 90, F.lit(90.0))
    return sums.select("scene_id", "feature_id", "area", turn.alias("angle_deg"))


def draw_line(lines: DataFrame, h: int, w: int) -> DataFrame:
    """scene_id, line_id, row, col of the pixels under each segment (r0, c0, r1, c1), sampled every half pixel and rounded half to even."""
    n = F.greatest(F.ceil(2 * F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))), F.lit(1)).cast("int")
    steps = lines.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: F.rint(F.col(a) + F.col("_k") / F.col("_n") * (F.col(b) - F.col(a))).cast("int")
    out = steps.select("scene_id", "line_id", at("r0", "r1").alias("row"), at("c0", "c1").alias("col"))
    return out.filter(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1)).distinct()


def global_affine(anchors: DataFrame, depth: str = "d", height: str = "value_m", weight: str = "weight", by: tuple[str, ...] = ("scene_id",), delta: float = 2.0, rounds: int = 3, lone_zero: bool = True) -> DataFrame:
    """Per group the robust line height = a depth + b: weighted least squares, reweighted by Huber's rule.

    ``anchors`` must hold absolute anchors only. Groups of one anchor have (1, 0), or without
    ``lone_zero`` what a group of constant depth has: slope 1 and the difference of the means. Each round is one aggregation;
    the fit of a round is joined back as one row a group.
    """
    d, h = F.col(depth), F.col(height)
    w0 = F.col(weight)
    rows = anchors.select(*by, d.alias("_d"), h.alias("_h"), w0.alias("_w0"))

    def fit(weighted: DataFrame) -> DataFrame:
        # Weighted moments about the group's own first means keep the sums small.
        w = F.col("_w")
        sums = weighted.groupBy(*by).agg(
            F.sum(w).alias("sw"), F.sum(w * F.col("_d")).alias("sd"), F.sum(w * F.col("_h")).alias("sh"),
            F.sum(w * F.col("_d") * F.col("_d")).alias("sdd"), F.sum(w * F.col("_d") * F.col("_h")).alias("sdh"), F.count("*").alias("n"),
        )
        md, mh = F.col("sd") / F.col("sw"), F.col("sh") / F.col("sw")
        var, cov = F.col("sdd") / F.col("sw") - md * md, F.col("sdh") / F.col("sw") - md * mh
        a = F.when((F.col("n") < 2) | (var < 1e-12), 1.0).otherwise(cov / var)
        b = mh - a * md
        if lone_zero:
            b = F.when(F.col("n") < 2, 0.0).otherwise(b)
        return sums.select(*by, a.alias("a"), b.alias("b"), "n")

    out = fit(rows.withColumn("_w", F.col("_w0")))
    for _ in range(rounds - 1):
        gap = F.abs(F.col("a") * F.col("_d") + F.col("b") - F.col("_h"))
        huber = F.least(F.lit(1.0), delta / F.greatest(gap, F.lit(1e-9)))
        out = fit(rows.join(out.select(*by, "a", "b"), list(by)).withColumn("_w", F.col("_w0") * huber))
    return out


def nearest_fill(px: DataFrame, v: str, name: str = "filled") -> DataFrame:
    """Adds ``name``: the value itself, or that of the nearest pixel that has one, at any distance; ties go to the least row, then column.

    Along each column two windows carry the nearest rows with a value above and below. Every hole
    then asks the columns of its row within a reach that doubles until the distance found is no
    larger than it, so a hole meets about as many columns as it is far from a value, and only holes
    still open go round again. A scene without any value stays null.
    """
    keys = ["scene_id", "row", "col"]
    above = W.partitionBy("scene_id", "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    below = W.partitionBy("scene_id", "col").orderBy("row").rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(v).isNotNull(), F.struct(F.col("row").alias("r"), F.col(v).alias("v")))
    sides = px.select(*keys, F.col(v).isNull().alias("hole"), F.last(at, ignorenulls=True).over(above).alias("u"), F.first(at, ignorenulls=True).over(below).alias("d"))
    sides = written(sides, "columns")
    lines = sides.select("scene_id", "row", F.col("col").alias("c"), "u", "d").filter("u is not null or d is not null")
    wide = px.groupBy("scene_id").agg(F.max("col").alias("last"))
    todo = sides.filter("hole").select(*keys).join(wide, "scene_id").join(lines.select("scene_id").distinct(), "scene_id", "left_semi")
    found, reach = None, 4
    while True:
        span = F.sequence(F.greatest(F.col("col") - reach, F.lit(0)), F.least(F.col("col") + reach, F.col("last")))
        met = todo.withColumn("c", F.explode(span)).join(lines, ["scene_id", "row", "c"], "left")
        side = lambda s: F.when(F.col(s).isNotNull(), F.struct((F.pow(F.col(f"{s}.r") - F.col("row"), F.lit(2)) + F.pow(F.col("c") - F.col("col"), F.lit(2))).alias("d2"), F.col(f"{s}.r").alias("r"), F.col("c"), F.col(f"{s}.v").alias("v")))
        best = met.groupBy(*keys, "last").agg(F.min(F.least(F.coalesce(side("u"), side("d")), F.coalesce(side("d"), side("u")))).alias("best"))
        # A value in a column farther than ``reach`` is farther than ``reach`` itself.
        done = F.coalesce(F.col("best.d2") <= reach * reach, F.lit(False)) | (F.lit(reach) >= F.greatest(F.col("col"), F.col("last") - F.col("col")))
        best = written(best.withColumn("done", done), "nearest")
        own = best.filter("done").select(*keys, F.col("best.v").alias("_v"))
        found = own if found is None else found.unionByName(own)
        todo = best.filter("not done").select(*keys, "last")
        if todo.isEmpty():
            break
        reach *= 2
    # A union forgets that its parts are never broadcast.
    return px.join(found.hint("merge"), keys, "left").withColumn(name, F.coalesce(v, "_v")).drop("_v")
