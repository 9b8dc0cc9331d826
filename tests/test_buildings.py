"""Mosaics, outlines, distances, pinches and solids against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import footprints, joins, mesh, mosaic, outlines, solids

PX = "scene_id int, row int, col int"


def pixels(spark, masks):
    """scene 0 and one mask_id for each boolean array."""
    rows = [(0, k, int(r), int(c)) for k, m in enumerate(masks) for r, c in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "scene_id int, mask_id int, row int, col int")


def random_masks(n=6, size=24, seed=2):
    rng = np.random.default_rng(seed)
    masks = [rng.random((size, size)) < p for p in np.linspace(0.3, 0.9, n)]
    ring = np.zeros((size, size), bool)
    ring[3:17, 2:20] = True
    ring[6:10, 5:9] = False
    ring[10, 9] = False  # two holes that meet at a corner
    corner = np.zeros((size, size), bool)
    corner[:5, :5] = corner[5:8, 5:8] = True
    return [*masks, ring, corner, np.ones((size, size), bool)]


# --- mosaics ---


def test_mosaic_of_a_plane_has_no_seams(spark):
    h, w, chip = 70, 90, 32
    rng = np.random.default_rng(1)
    row, col = np.mgrid[0:h, 0:w]
    z = 0.3 * row + 0.7 * col + 5 * np.sin(row / 9)
    px = spark.createDataFrame([(s, int(r), int(c), float(z[r, c])) for s in (0, 1) for r in range(h) for c in range(w)], PX + ", z double")
    chips = mosaic.chip_windows(px, h, w, chip, 0.5)
    corners = {(r["scene_id"], r["r"], r["c"]) for r in chips.select("scene_id", "r", "c").distinct().collect()}
    assert corners == {(s, r, c) for s in (0, 1) for r in (0, 16, 32, 38) for c in (0, 16, 32, 48, 58)}
    maps = spark.createDataFrame([(*k, float(rng.uniform(0.4, 2)), float(rng.normal())) for k in sorted(corners)], "scene_id int, r int, c int, a double, b double")
    seen = chips.join(maps, ["scene_id", "r", "c"]).withColumn("v", F.col("a") * F.col("z") / 70 + F.col("b"))
    seen = seen.withColumn("v", F.when((F.col("row") == 40) & (F.col("col") == 41), None).otherwise(F.col("v")))
    out = mosaic.blend_mosaic(seen, "v", chip, 8).toPandas()
    want = (z - z.min()) / (z.max() - z.min())
    assert len(out) == 2 * (h * w - 1)
    assert np.abs(out["relative"] - want[out["row"], out["col"]]).max() < 1e-6


def test_tree_reaches_every_chip_and_chips_apart_keep_their_scale(spark):
    far = spark.createDataFrame([(0, 0, 0), (0, 0, 20), (0, 0, 60), (0, 20, 0), (0, 20, 20)], "scene_id int, r int, c int")
    got = {(r["r"], r["c"]): (r["pr"], r["pc"]) for r in mosaic.chip_tree(far, 32).collect()}
    assert got == {(0, 0): (None, None), (0, 20): (0, 0), (0, 60): (None, None), (20, 0): (0, 0), (20, 20): (20, 0)}
    one = far.filter("c = 60").withColumns({"row": F.lit(1), "col": F.explode(F.sequence(F.lit(60), F.lit(70)))}).withColumn("v", F.lit(2.0))
    assert {r["relative"] for r in mosaic.blend_mosaic(one, "v", 32, 4).collect()} == {2.0}


def ranks_by_force(a):
    flat = a.ravel()
    if np.ptp(flat) == 0:
        return np.full(a.shape, 0.5)
    return np.array([((flat < v).sum() + ((flat == v).sum() - 1) / 2) / (flat.size - 1) for v in flat]).reshape(a.shape)


@pytest.mark.parametrize("batch", [1, 3])
def test_predicted_chips_equal_brute_force(spark, batch):
    h, w, chip = 20, 44, 16
    rng = np.random.default_rng(4)
    band = rng.integers(0, 50, (h, w))
    px = spark.createDataFrame([(0, r, c, int(band[r, c])) for r in range(h) for c in range(w)], PX + ", g int")
    got = mosaic.predict_chips(px, ("g",), h, w, lambda x: -x[..., 0].astype(float), chip, 0.25, batch).toPandas()
    for (r, c), own in got.groupby(["r", "c"]):
        want = ranks_by_force(-band[r : r + chip, c : c + chip])
        assert len(own) == chip * chip and np.allclose(own["depth"], want[own["row"] - r, own["col"] - c])
    assert set(zip(got["r"], got["c"], strict=True)) == {(r, c) for r in (0, 4) for c in (0, 12, 24, 28)}


def test_small_rasters_are_padded_and_wrong_shapes_refused(spark):
    px = spark.createDataFrame([(0, r, c, 10 * r + c) for r in range(5) for c in range(7)], PX + ", g int")
    whole = np.pad(np.add.outer(10 * np.arange(5), np.arange(7)), ((0, 5), (0, 3)), mode="edge")

    def same(x):
        assert (x[0, ..., 0] == whole).all()
        return x[..., 0].astype(float)

    got = mosaic.predict_mosaic(px, ("g",), 5, 7, same, 10, 0.25).toPandas()
    want = ranks_by_force(whole)[:5, :7]
    assert np.allclose(got["relative"], ((want - want.min()) / (want.max() - want.min()))[got["row"], got["col"]])
    with pytest.raises(Exception, match="the predictor gave"):
        mosaic.predict_chips(px, ("g",), 5, 7, lambda x: x[:, :3, :, 0], 10).count()


# --- outlines ---


def rings_by_force(mask):
    """Rings walked with the mask on the right, turning right first: a list of (edges, area)."""
    inside = lambda y, x: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and bool(mask[y, x])
    step = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    beyond = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    todo = {(int(y), int(x), k) for y, x in zip(*np.nonzero(mask), strict=True) for k in range(4) if not inside(y + beyond[k][0], x + beyond[k][1])}
    out = []
    while todo:
        start = now = min(todo)
        ring = []
        while True:
            todo.discard(now)
            ring.append(now)
            y, x, k = now
            dy, dx = step[k]
            if not inside(y + dy, x + dx):
                now = (y, x, (k + 1) % 4)
            elif not inside(y + dy + beyond[k][0], x + dx + beyond[k][1]):
                now = (y + dy, x + dx, k)
            else:
                now = (y + dy + beyond[k][0], x + dx + beyond[k][1], (k - 1) % 4)
            if now == start:
                break
        at = [[(y, x), (y, x + 1), (y + 1, x + 1), (y + 1, x)][k] for y, x, k in ring]
        area = sum(x0 * y1 - x1 * y0 for (y0, x0), (y1, x1) in zip(at, at[1:] + at[:1], strict=True)) / 2
        corners = [p for p, (_, _, k), (_, _, j) in zip(at, ring, ring[-1:] + ring[:-1], strict=True) if k != j]
        out.append((len(ring), area, frozenset(corners)))
    return sorted(out, key=lambda t: (t[0], t[1], sorted(t[2])))


def test_outlines_equal_a_walk(spark):
    masks = random_masks()
    rings = outlines.trace_outlines(pixels(spark, masks), 25).collect()
    for k, mask in enumerate(masks):
        own = [r for r in rings if r["mask_id"] == k]
        got = sorted(((r["n_edges"], r["area"], frozenset((p["y"], p["x"]) for p in r["pts"])) for r in own), key=lambda t: (t[0], t[1], sorted(t[2])))
        assert got == rings_by_force(mask), k
        assert sum(r["area"] for r in own) == mask.sum()
        for r in own:  # corners in order close a ring of that length, turning at each
            p = [(q["y"], q["x"]) for q in r["pts"]]
            assert sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(p, p[1:] + p[:1], strict=True)) == r["n_edges"]
    # Polygons give the same areas by the shoelace operator.
    polygons = spark.createDataFrame([(0, i, [tuple(map(float, (q["y"], q["x"]))) for q in r["pts"]]) for i, r in enumerate(rings)], "scene_id int, feature_id int, pts array<struct<y: double, x: double>>")
    assert {r["feature_id"]: r["area"] for r in joins.polygon_area(polygons).collect()} == {i: abs(r["area"]) for i, r in enumerate(rings)}
    longest = {r["mask_id"]: r["n_edges"] for r in outlines.longest_outline(outlines.trace_outlines(pixels(spark, masks), 25)).collect()}
    assert longest == {k: max(n for n, _, _ in rings_by_force(m)) for k, m in enumerate(masks)}


def test_long_rings_link(spark):
    comb = np.zeros((41, 120), bool)
    comb[0] = True
    comb[:, ::2] = True
    (ring,) = outlines.trace_outlines(pixels(spark, [comb]), 121).collect()
    assert ring["area"] == comb.sum() and ring["n_edges"] > 4000


# --- distances and samples ---


def distance_by_force(mask):
    out, zero = {}, np.argwhere(~mask)
    for r, c in np.argwhere(mask):
        out[int(r), int(c)] = int(((zero - (r, c)) ** 2).sum(1).min()) if len(zero) else None
    return out


def test_distances_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    big = np.ones((200, 200), bool)
    big[rng.integers(0, 200, 12), rng.integers(0, 200, 12)] = False
    big[:, :3] = False
    for masks, size in ((random_masks(), 24), ([big], 200)):
        got = solids.distance_interior(pixels(spark, masks), size, size).collect()
        for k, mask in enumerate(masks):
            assert {(r["row"], r["col"]): r["d2"] for r in got if r["mask_id"] == k} == distance_by_force(mask)


def test_facades_take_the_deepest_admissible_pixel(spark):
    size = 24
    masks = random_masks()
    rng = np.random.default_rng(5)
    sem, road = rng.integers(0, 9, (size, size)), rng.random((size, size)) < 0.1
    sem[:8, :8] = 3
    masks.append(np.zeros((size, size), bool))
    masks[-1][:4, :4] = True  # only vegetation
    flags = spark.createDataFrame([(0, r, c, int(sem[r, c]), bool(road[r, c])) for r in range(size) for c in range(size)], PX + ", sem int, by_road boolean")
    flags = flags.withColumn("by_class", solids.inadmissible(F.col("sem")))
    got = {r["mask_id"]: r for r in solids.facade_sample(pixels(spark, masks), flags, size, size).collect()}
    for k, mask in enumerate(masks):
        bad, way = np.isin(sem, (1, 3, 4)), road & True
        names = [n for n, x in (("semantic road/vegetation/water", bad), ("the OSM road network", way)) if (mask & x).any()]
        fine = mask & ~bad & ~way
        d = distance_by_force(fine if fine.any() else mask)
        best = max(d, key=lambda p: (d[p], -p[0], -p[1]))
        assert (got[k]["row"], got[k]["col"]) == best and abs(got[k]["depth"] - d[best] ** 0.5) < 1e-9
        want = "deepest interior pixel" + (", after excluding " if names else "") + " and ".join(names)
        assert got[k]["reason"] == (want if fine.any() else "no admissible interior pixel - the whole footprint reads as " + " and ".join(names))


def test_core_values_reach_the_rim(spark):
    rng = np.random.default_rng(6)
    masks = random_masks(3)
    value = rng.random((24, 24))
    core = [m & (rng.random(m.shape) < 0.1) for m in masks]
    core[1][:] = False
    core_px = pixels(spark, core).join(spark.createDataFrame([(r, c, float(value[r, c])) for r in range(24) for c in range(24)], "row int, col int, z double"), ["row", "col"])
    got = {(r["mask_id"], r["row"], r["col"]): r["z"] for r in solids.extend_from_core(pixels(spark, masks), core_px, "z").collect()}
    want = {}
    for k, (m, c) in enumerate(zip(masks, core, strict=True)):
        at = np.argwhere(c)
        for p in np.argwhere(m):
            if len(at):
                q = min(map(tuple, at), key=lambda q: ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, q[0], q[1]))
                want[k, int(p[0]), int(p[1])] = float(value[q])
    assert got == want


# --- cells and solids ---


def unpinched_by_force(cells, passes=4):
    out = {tuple(map(int, p)) for p in np.argwhere(cells)}
    for _ in range(passes):
        gone = set()
        for y in range(-1, cells.shape[0] + 1):
            for x in range(-1, cells.shape[1] + 1):
                a, b, c, d = ((y - 1 + i, x - 1 + j) in out for i in (0, 1) for j in (0, 1))
                gone |= {(y, x)} if a and d and not b and not c else {(y, x - 1)} if b and c and not a and not d else set()
        out -= gone
    return out


def test_no_pinch_is_left(spark):
    masks = random_masks(8, seed=9)
    got = solids.unpinch(pixels(spark, masks)).collect()
    for k, m in enumerate(masks):
        assert {(r["row"], r["col"]) for r in got if r["mask_id"] == k} == unpinched_by_force(m)
    again = solids.unpinch(pixels(spark, masks), passes=30)
    around = again.select("mask_id", F.explode(F.array(*(F.struct((F.col("row") + i).alias("y"), (F.col("col") + j).alias("x"), F.lit(8 >> (2 * i + j)).alias("b")) for i in (0, 1) for j in (0, 1)))).alias("p"))
    assert around.groupBy("mask_id", "p.y", "p.x").agg(F.sum("p.b").alias("s")).filter("s in (6, 9)").count() == 0


def test_solids_are_closed_and_walls_upright(spark):
    size = 25
    masks = random_masks(4)
    cells = solids.unpinch(pixels(spark, masks), passes=30)
    px = spark.createDataFrame([(0, r, c, 10.0 + (r * 3 + c * 5) % 7) for r in range(size) for c in range(size)], PX + ", z double")
    ground = spark.createDataFrame([(0, k, float(k)) for k in range(len(masks))], "scene_id int, mask_id int, ground_m double")
    roof = solids.cells_to_pixels(cells).join(px, ["scene_id", "row", "col"])
    for floor in (False, True):
        v, f = solids.building_solids(cells, roof, ground, size, size, 0.5, floor=floor)
        own = v.select("scene_id", "vid", "x", "y", "z")
        report = mesh.validate_mesh(own, f).first()
        assert (report["n_degenerate"], report["n_unreferenced"], report["n_nonmanifold"]) == (0, 0, 0)
        walls = f.filter("part = 'wall'").count() // 2
        assert report["n_boundary"] == (0 if floor else walls) and walls > 0
        assert mesh.normal_consistency(f).first()["consistency"] == 1
        assert mesh.verticality(own, f.filter("part = 'wall'")).first()["wall_share"] == 1
        assert sorted(r["vid"] for r in v.collect()) == list(range(report["n_vertices"]))
        n = {r["part"]: r["nz"] for r in f.join(mesh.face_normals(own, f), ["scene_id", "fid"]).groupBy("part").agg(F.min("nz").alias("nz")).collect()}
        assert n["roof"] > 0 and abs(n["wall"]) < 1e-12 and n.get("floor", -1) == -1
    # The volume that the faces enclose is that under the roofs.
    p = own.select("scene_id", "vid", "x", "y", "z")
    t = f.select("fid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid")).join(p, "vid").toPandas().sort_values(["fid", "k"])
    corners = t[["x", "y", "z"]].to_numpy().reshape(-1, 3, 3)
    volume = np.einsum("ij,ij->i", corners[:, 0], np.cross(corners[:, 1], corners[:, 2])).sum() / 6
    z = {(r["row"], r["col"]): r["z"] for r in px.collect()}
    want = 0.0
    for c in cells.collect():
        a, b, s, e = (z[c["row"] + i, c["col"] + j] - c["mask_id"] for i in (0, 1) for j in (0, 1))
        want += 0.125 * ((a + s + e) / 3 + (a + e + b) / 3)
    assert abs(volume - want) < 1e-6


def test_roofs_follow_their_mode(spark):
    mask = np.zeros((20, 20), bool)
    mask[2:14, 3:17] = True
    own = pixels(spark, [mask, mask, mask])
    px = spark.createDataFrame([(0, r, c, 20.0 + 0.5 * c + (9.0 if (r, c) in ((6, 6), (2, 3)) else 0.0)) for r in range(20) for c in range(20)], PX + ", z double")
    roofs = spark.createDataFrame([(0, 0, "platform", 25.0, None, None, None), (0, 1, "plane", 25.0, 0.5, 0.0, 20.0), (0, 2, "measured", 25.0, None, None, None)], "scene_id int, mask_id int, mode string, platform_m double, a double, b double, c double")
    cells = footprints.to_cells(own)
    got = {(r["mask_id"], r["row"], r["col"]): r["z"] for r in solids.roof_heights(cells, px, "z", roofs).collect()}
    assert {got[0, r, c] for r in range(2, 14) for c in range(3, 17)} == {25.0}
    # The spike stands off the plane and stays; the rim has the core's heights, not its own.
    assert got[1, 7, 9] == 24.5 and got[1, 6, 6] == 32.0 and got[2, 2, 3] == got[2, 4, 5] == 22.5
    chosen = footprints.choose_roof(own.filter("mask_id = 0").join(px, ["scene_id", "row", "col"]), planes=True).first()
    assert chosen["mode"] == "plane" and abs(chosen["a"] - 0.5) < 1e-9 and abs(chosen["c"] - 20) < 1e-6


def test_facades_read_their_own_building(spark):
    size = 30
    mask = np.zeros((size, size), bool)
    mask[4:20, 6:22] = True
    own = pixels(spark, [mask])
    road = spark.createDataFrame([(0, r, c) for r in range(size) for c in range(size) if not mask[r, c]], PX)
    cells = footprints.to_cells(own)
    z = solids.cells_to_pixels(cells).withColumn("z", F.lit(9.0))
    v, _ = solids.building_solids(cells, z, own.select("scene_id", "mask_id").distinct().withColumn("ground_m", F.lit(0.0)), size, size, 0.5)
    flags = road.withColumns({"by_class": F.lit(False), "by_road": F.lit(True)})
    uv = solids.facade_uv(v, solids.facade_sample(own, flags, size, size), size, size, 0.5)
    audit = solids.uv_audit(uv, road, own, size, size).first()
    assert audit["wall_vertices"] == 60 and audit["sampling_road"] == 0 and audit["sampling_own_footprint"] == 1
    rim = uv.filter("part = 'roof' and row = 4 and col = 6").first()
    assert abs(np.hypot(rim["uv_row"] - 4, rim["uv_col"] - 6) - 2.4) < 1e-9 and rim["uv_row"] > 4
    tiny = v.filter("part = 'roof'").filter("row < 6 and col < 8")
    moved = solids.facade_uv(tiny, flags.limit(0).withColumn("mask_id", F.lit(0)), size, size, 0.5).filter("row = 4 and col = 6").first()
    assert abs(moved["uv_row"] - 4 - 0.225) < 1e-9


def test_zones_tell_outliers_and_why_they_are_refused(spark):
    size = 40
    z = np.ones((size, size))
    sem = np.full((size, size), 2)
    boxes = [(2, 2, 10, 10), (2, 20, 10, 10), (20, 2, 8, 8), (20, 20, 5, 9), (32, 2, 3, 20)]
    masks = []
    for k, (y, x, h, w) in enumerate(boxes):
        m = np.zeros((size, size), bool)
        m[y : y + h, x : x + w] = True
        z[m] = 8 + k
        masks.append(m)
    z[5, 5] = 30.0  # one of 36 roof pixels
    z[2, 2] = 90.0  # on the rim, which isn't read
    sem[2:12, 20:24] = 3
    sem[20:28, 2:8] = 3
    z[22:26, 24] = np.nan
    px = spark.createDataFrame([(0, r, c, int(sem[r, c]), float(z[r, c]) if np.isfinite(z[r, c]) else None) for r in range(size) for c in range(size)], PX + ", sem int, z double").withColumn("dtm", F.lit(0.5))
    from rasterloom.operators import instances

    got = {r["mask_id"]: r for r in instances.zonal_measure(pixels(spark, masks), px, "z").collect()}
    assert (got[0]["n_px"], got[0]["n_roof"], got[0]["roof_m"], got[0]["height_m"], got[0]["refused"], got[0]["note"]) == (100, 36, 8.0, 7.0, None, "")
    assert abs(got[0]["outlier_share"] - 1 / 36) < 1e-9
    assert got[1]["refused"] is None and got[1]["note"] == "40% of this footprint reads as vegetation"
    assert got[2]["refused"] == "vegetation"
    assert got[3]["n_roof"] == 4 and got[3]["refused"] == "few roof pixels"
    # No pixel lies two inside: the whole mask is read.
    assert got[4]["n_roof"] == 60 and got[4]["refused"] is None
    bare = {r["mask_id"]: r for r in instances.zonal_measure(pixels(spark, masks), px, "z", ground="dtm").collect()}
    assert bare[0]["height_m"] == 7.5


def test_refined_heights_hold_their_mean_and_stay_bounded(spark):
    from rasterloom.operators import surfaces

    size = 40
    rng = np.random.default_rng(8)
    z = np.zeros((size, size))
    z[10:25, 12:30] = 8
    z += rng.random((size, size))
    guide = np.where(z > 4, 0.8, 0.2)
    px = spark.createDataFrame([(0, r, c, None if (r, c) == (3, 3) else float(z[r, c]), float(guide[r, c])) for r in range(size) for c in range(size)], PX + ", z double, g double")
    z[3, 3] = 0

    def box(a, k):
        p = np.pad(a, k, mode="edge")
        return np.lib.stride_tricks.sliding_window_view(p, (2 * k + 1, 2 * k + 1)).mean((2, 3))

    a = (box(guide * z, 2) - box(guide, 2) * box(z, 2)) / (box(guide * guide, 2) - box(guide, 2) ** 2 + 4e-3)
    b = box(z, 2) - a * box(guide, 2)
    dz = box(a, 2) * guide + box(b, 2) - z
    for clamp, most in ((None, 0.25 * np.percentile(np.round(z, 3), 99)), (0.2, 0.2)):
        want = np.maximum(z + np.clip(dz - box(dz, 6), -most, most), 0)
        got = surfaces.refine_heights(px, "z", "g", size, size, 1.0, clamp=clamp, preserve=6.0).toPandas()
        assert np.abs(got["refined"] - want[got["row"], got["col"]]).max() < 1e-3 and np.abs(got["moved"]).max() <= most + 1e-3
        assert np.allclose(got["refined"] - got["moved"], z[got["row"], got["col"]])


def test_nearest_classes(spark):
    px = spark.createDataFrame([(0, r, c, 10 * r + c) for r in range(4) for c in range(5)], PX + ", k int")
    at = [(0, 0.49, 0.0), (0, 0.5, 1.5), (0, 1.5, 3.2), (0, 3.0, 4.0), (0, 3.1, 0.0), (0, -0.2, 0.0)]
    got = joins.nearest_at(px, spark.createDataFrame(at, "scene_id int, y double, x double"), "k", 4, 5, "k")
    assert {(r["y"], r["x"]): r["k"] for r in got.collect()} == {(0.49, 0.0): 0, (0.5, 1.5): 2, (1.5, 3.2): 23, (3.0, 4.0): 34, (3.1, 0.0): None, (-0.2, 0.0): None}


def test_planes_are_fitted_again_without_chimneys(spark):
    rng = np.random.default_rng(9)
    groups = {0: 12, 1: 7, 2: 12, 3: 9}
    rows, want = [], {}
    for k, n in groups.items():
        y, x = (v.ravel() for v in np.mgrid[0:n, 0:n]) if k != 1 else (np.zeros(7, int), np.arange(7))
        z = 20 + 0.3 * x - 0.2 * y + rng.normal(scale=0.02, size=x.size)
        if k in (0, 3):
            z[: 4 if k == 0 else 20] += 6
        rows += [(0, k, int(r), int(c), float(v)) for r, c, v in zip(y, x, z, strict=True)]
        if z.size < 8:
            want[k] = (z.size, None, 0.0, None)
            continue
        m = np.stack([x, y, np.ones_like(x)], 1).astype(float)
        fit = np.linalg.lstsq(m, z, rcond=None)[0]
        r = z - m @ fit
        keep = np.abs(r) <= max(0.6, 3 * np.median(np.abs(r - np.median(r))))
        if 8 <= keep.sum() < z.size:
            fit = np.linalg.lstsq(m[keep], z[keep], rcond=None)[0]
            r = z - m @ fit
        want[k] = (z.size, fit, (np.abs(r) <= 0.6).mean(), np.sqrt((r**2).mean()))
    got = {r["mask_id"]: r for r in footprints.refit_plane(spark.createDataFrame(rows, "scene_id int, mask_id int, row int, col int, z double")).collect()}
    assert set(got) == set(want)
    for k, (n, fit, inlier, rmse) in want.items():
        assert got[k]["n"] == n and abs(got[k]["inlier"] - inlier) < 1e-9
        if fit is None:
            assert got[k]["a"] is None and got[k]["rmse"] is None
        else:
            assert np.allclose([got[k][c] for c in "abc"], fit) and abs(got[k]["rmse"] - rmse) < 1e-9
    assert abs(got[0]["a"] - 0.3) < 0.01


def test_coverage_and_provenance(spark, tmp_path):
    from rasterloom.sources import scenes

    grid = spark.createDataFrame([(s, r, c) for s in (0, 1) for r in range(4) for c in range(5)], PX)
    found = grid.filter("scene_id = 0 and row < 3").withColumn("v", F.when(F.col("col") > 0, F.lit(2.0)))
    cover = scenes.dem_coverage(found, grid)
    assert {r["scene_id"]: (r["coverage"], r["reason"]) for r in cover.collect()} == {0: (0.6, None), 1: (0.0, "no elevation tile covers the scene")}
    assert scenes.require_coverage(cover.filter("scene_id = 0")).count() == 1
    with pytest.raises(ValueError, match="scene 1: no elevation tile"):
        scenes.require_coverage(cover)
    told = spark.createDataFrame([(0, "A", 0.6)], "scene_id int, tier string, coverage double")
    scenes.write_layers(found, str(tmp_path / "x"), ["v"], told)
    assert scenes.read_provenance(spark, str(tmp_path / "x")).collect() == told.collect()
    back = spark.read.parquet(str(tmp_path / "x"))
    assert set(back.columns) == {"row", "col", "v", "scene_id", "layer"} and back.count() == 12


def test_rings_within_a_chunk_are_linked_before_any_round(spark, monkeypatch):
    """Whole rings of a chunk need no round; rings that a chunk or a band of rows cuts are linked by rounds, with the same result."""
    assert [x.tolist() for x in outlines.closed_rings(np.array([3, 5, 8, 9]), np.array([8, 9, 5, 3]))] == [[0, 0, 0, 0], [0, 2, 3, 1]]
    assert outlines.closed_rings(np.array([3, 5, 8, 9]), np.array([5, 3, 9, 7]))[0].tolist() == [0, 0, -1, -1]
    masks = [np.pad(np.ones((9, 5), bool), 1), np.eye(7, dtype=bool)]
    rows = lambda: sorted((r["mask_id"], r["ring"], r["n_edges"], r["area"], tuple(r["pts"])) for r in outlines.trace_outlines(pixels(spark, masks), 25).collect())
    rounds = []
    keep = outlines.written
    monkeypatch.setattr(outlines, "written", lambda df, name: rounds.append(name) or keep(df, name))
    whole = rows()
    assert rounds == ["ring-edges"] and len(whole) == 8
    monkeypatch.setattr(outlines, "BAND_BITS", 2)
    monkeypatch.setattr(outlines, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert rows() == whole and "rings" in rounds
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
