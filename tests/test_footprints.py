"""Suppression, roofs, mesh components, hole filling and quantiles against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import footprints, joins, mesh, ranks


def test_box_nms_is_greedy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        y, x, h, w = rng.integers(0, 90), rng.integers(0, 90), rng.integers(4, 30), rng.integers(4, 30)
        rows.append((i % 2, i, int(y), int(x), int(y + h), int(x + w), int(rng.integers(0, 40)), int(h * w)))
    table = spark.createDataFrame(rows, "scene_id int, mask_id long, y0 int, x0 int, y1 int, x1 int, score int, area_px long")
    want = set()
    for scene in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == scene), key=lambda r: (-r[6], r[1])):
            def over(q, r=r):
                both = max(0, min(q[4], r[4]) - max(q[2], r[2])) * max(0, min(q[5], r[5]) - max(q[3], r[3]))
                return both > 0.3 * (q[7] + r[7] - both)

            if not any(over(q) for q in kept):
                kept.append(r)
        want |= {(scene, r[1], k + 1) for k, r in enumerate(sorted(kept, key=lambda r: (-r[7], r[1])))}
    got = footprints.box_nms(table, 0.3, cell=16).collect()
    assert {(r["scene_id"], r["mask_id"], r["rank"]) for r in got} == want
    assert footprints.box_nms(table.limit(0)).count() == 0


def test_roofs_flat_tilted_and_rough(spark):
    rng = np.random.default_rng(2)
    y, x = (a.ravel() for a in np.mgrid[0:12, 0:12])
    surfaces = {0: 10 + 0.05 * rng.normal(size=144), 1: 10 + 0.4 * x + 0.05 * rng.normal(size=144), 2: 10 + 9 * rng.normal(size=144), 3: 10 + 0.4 * x}
    surfaces[3] = surfaces[3] + np.where(np.arange(144) % 29 == 0, 6.0, 0.0)  # chimneys
    rows = [(0, k, int(a), int(b), float(v)) for k, z in surfaces.items() for a, b, v in zip(y, x, z, strict=True)] + [(0, 9, 0, i, 5.0) for i in range(4)]
    out = {r["mask_id"]: r for r in footprints.choose_roof(spark.createDataFrame(rows, "scene_id int, mask_id int, row int, col int, z double")).collect()}
    assert [out[k]["mode"] for k in (0, 1, 2, 9)] == ["platform", "plane", "measured", "measured"]
    assert abs(out[1]["pitch_m"] - 4.4) < 0.1 and out[1]["inlier"] == 1.0
    # The second fit leaves the chimneys out, so the slope is that of the roof.
    assert abs(out[3]["pitch_m"] - 4.4) < 1e-6 and out[3]["inlier"] == 1 - 5 / 144


def test_mesh_components_by_force(spark):
    rng = np.random.default_rng(3)
    cells = rng.random((20, 20)) < 0.45
    px = spark.createDataFrame([(s, int(r), int(c), 1.0) for s in (0, 1) for r, c in zip(*np.nonzero(cells if s else ~cells), strict=True)], "scene_id int, row int, col int, z double")
    faces = mesh.grid_mesh(px, "z", 20, 20)[1]
    got = {(r["scene_id"], r["vid"]): r["label"] for r in mesh.mesh_components(faces, 400).collect()}
    label = {}
    rows = faces.collect()
    for r in rows:
        for v in (r["a"], r["b"], r["c"]):
            label[r["scene_id"], v] = v
    for _ in range(60):
        for r in rows:
            keys = [(r["scene_id"], v) for v in (r["a"], r["b"], r["c"])]
            least = min(label[k] for k in keys)
            label.update({k: least for k in keys})
    assert got == label


def test_holes_fill_from_any_distance(spark):
    rng = np.random.default_rng(4)
    h, w = 9, 70
    z = np.where(rng.random((3, h, w)) < 0.02, rng.integers(1, 99, (3, h, w)), 0)
    z[1] = 0
    z[1, 8, 69] = 7  # one value far from everything
    z[2] = 0
    rows = [(s, r, c, int(z[s, r, c]) or None) for s, r, c in itertools.product(range(3), range(h), range(w))]
    got = {(r["scene_id"], r["row"], r["col"]): r["filled"] for r in joins.nearest_fill(spark.createDataFrame(rows, "scene_id int, row int, col int, z int"), "z").collect()}
    for s in range(3):
        at = np.argwhere(z[s])
        for r, c in itertools.product(range(h), range(w)):
            want = None
            if len(at):
                best = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in at.tolist())
                want = int(z[s, best[1], best[2]])
            assert got[s, r, c] == want


def test_quantiles_by_blocks(spark):
    rng = np.random.default_rng(5)
    values = {k: np.round(rng.normal(0, 30, n), 3) for k, n in (("a", 5000), ("b", 7), ("c", 1))}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None)]
    out = {r["k"]: r["q"] for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double"), "v", (0.0, 0.05, 0.5, 0.99, 1.0), ("k",), cells=64).collect()}
    assert set(out) == {"a", "b", "c"}
    assert all(np.allclose(out[k], np.quantile(v, [0, 0.05, 0.5, 0.99, 1]), atol=1e-9) for k, v in values.items())


def test_quantiles_between_equal_values_are_those_values(spark):
    """Edges of bins are compared with the rows they come from, so an edge between equal values may not be off in its last digit."""
    values = [k / 1000 for k in range(500, 4500, 37)]
    at = tuple(k / 10 for k in range(1, 10))
    df = spark.createDataFrame([(v,) for v in values], "k double").crossJoin(spark.range(7)).withColumn("v", F.col("k"))
    out = ranks.exact_quantiles(df, "v", at, ("k",)).collect()
    assert len(out) == len(values) and all(list(r["q"]) == [r["k"]] * 9 for r in out)


def test_exact_quantiles_and_ranks_by_blocks(spark):
    rng = np.random.default_rng(5)
    parts = [rng.normal(0, 1e-3, 400), rng.normal(400, 30, 700), np.repeat(7.25, 900), -np.exp2(np.arange(-40, 40)), [0.0, -0.0, 1e300, -1e300, 8.0, np.nextafter(8, 0)]]
    values = [float(x) for x in np.concatenate(parts)]
    rows = [("a", v) for v in values] + [("b", 3.0), ("c", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = (0.0, 0.05, 0.333, 0.5, 0.92, 1.0)
    out = {r["k"]: (r["n"], r["q"]) for r in ranks.exact_quantiles(df, "v", at, ("k",)).collect()}
    assert set(out) == {"a", "b", None} and out["b"] == (1, [3.0] * 6) and np.allclose(out[None][1], [1.0, 1.05, 1.333, 1.5, 1.92, 2.0])
    assert out["a"][0] == len(values) and np.allclose(out["a"][1], np.quantile(values, at), rtol=1e-12)
    got = [(r["v"], r["r"]) for r in ranks.average_ranks(df, "v", ("k",), "r").filter("k = 'a'").collect()]
    order = np.sort(values)
    want = {v: (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in values}
    assert len(got) == len(values) and all(r == want[v] for v, r in got)
    assert ranks.average_ranks(df, "v", ("k",), "r").filter("k = 'c'").first()["r"] is None
    # Blocks rise with the values, also beside powers of two, where logarithms round.
    edges = np.unique(np.concatenate([[np.nextafter(p, 0), p, np.nextafter(p, 2 * p)] for p in np.exp2(np.arange(-60, 61))]))
    table = spark.createDataFrame([(float(v),) for v in edges], "v double").select("v", ranks.block_of(F.col("v")).alias("b"))
    blocks = [r["b"] for r in table.orderBy("v").collect()]
    assert blocks == sorted(blocks)


def spread(start, inside):
    """Pixels of ``inside`` that 4-connected steps reach from ``start``."""
    seen, todo = set(), [p for p in start if p in inside]
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [q for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)) if q in inside]
    return seen


def snapped_by_force(mask, light, band, radius, eps):
    h, w = mask.shape

    def box(a):
        for axis in (1, 0):
            width = [(radius, radius) if k == axis else (0, 0) for k in (0, 1)]
            p = np.pad(a, width, "edge")
            a = sum(np.take(p, range(i, i + a.shape[axis]), axis) for i in range(2 * radius + 1)) / (2 * radius + 1)
        return a

    s = mask.astype(float)
    ms, mg = box(s), box(light)
    a = (box(s * light) - ms * mg) / (box(light * light) - mg * mg + eps)
    soft = box(a) * light + box(ms - a * mg)
    out = mask.copy()
    p = np.pad(mask, band)
    views = [p[i : i + h, j : j + w] for i in range(2 * band + 1) for j in range(2 * band + 1)]
    ring = np.any(views, 0) & ~np.all(views, 0)
    out[ring] = soft[ring] >= 0.5
    left, parts = {(int(y), int(x)) for y, x in np.argwhere(out)}, []
    while left:
        parts.append(spread([min(left)], left))
        left -= parts[-1]
    if not parts or mask.all():
        return {(int(y), int(x)) for y, x in np.argwhere(mask)}
    best = max(parts, key=lambda q: (len(q), [-c for c in min(q)]))
    around = {(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1)} - best
    return {(y, x) for y in range(h) for x in range(w)} - spread([(-1, -1)], around)


def test_snapped_outlines_follow_the_image(spark):
    h, w = 36, 40
    rng = np.random.default_rng(11)
    light = np.where((np.mgrid[0:h, 0:w][0] > 8) & (np.mgrid[0:h, 0:w][1] > 11), 0.8, 0.2) + rng.normal(0, 0.02, (h, w))
    light[:, 30:] = rng.random((h, 10))
    masks = np.zeros((6, h, w), bool)
    masks[0, 7:20, 10:24] = True  # two pixels off the edge in the image
    masks[1, 0:9, 28:40] = True  # at the raster's corner, over noise
    masks[2] = rng.random((h, w)) < 0.55  # shattered
    masks[3, 20:33, 24:38] = True
    masks[3, 25:28, 29:32] = False  # a hole
    masks[4] = True
    masks[5, 2, 2] = True  # vanishes, so it stays
    rows = [(1, k, int(y), int(x)) for k, m in enumerate(masks) for y, x in np.argwhere(m)]
    px = spark.createDataFrame([(1, y, x, float(light[y, x])) for y in range(h) for x in range(w)], "scene_id int, row int, col int, light double")
    own = spark.createDataFrame(rows + rows[:50], "scene_id int, mask_id int, row int, col int")
    got = {k: set() for k in range(6)}
    found = footprints.snap_footprint(own, px, "light", h, w).collect()
    for r in found:
        got[r["mask_id"]].add((r["row"], r["col"]))
    assert len(found) == sum(map(len, got.values()))
    for k, m in enumerate(masks):
        assert got[k] == snapped_by_force(m, light, 3, 4, 1e-4), k
    assert (9, 12) in got[0] and (7, 15) not in got[0] and (15, 10) not in got[0]
    assert footprints.snap_footprint(own.limit(0), px, "light", h, w).count() == 0
