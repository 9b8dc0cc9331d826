"""Shadows, land cover and prominence against plain loops on small rasters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import scenery

H, W = 26, 31


def shifted(m, y, x):
    out = np.zeros_like(m)
    h, w = m.shape
    out[max(0, -y) : h - max(0, y), max(0, -x) : w - max(0, x)] = m[max(0, y) : h - max(0, -y), max(0, x) : w - max(0, -x)]
    return out


def box(m, r, fold):
    return fold.reduce([shifted(m, y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)])


def opened(m, r):
    return box(box(m, r, np.logical_and), r, np.logical_or)


def closed(m, r):
    return box(box(m, r, np.logical_or), r, np.logical_and)


def components(m):
    left, out = set(zip(*np.nonzero(m), strict=True)), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(part)
    return out


def otsu(v):
    hist, edges = np.histogram(v, 256)
    centre, total = (edges[:-1] + edges[1:]) / 2, hist.sum()
    n0, s0 = np.cumsum(hist), np.cumsum(hist * centre)
    n1 = total - n0
    with np.errstate(all="ignore"):
        between = np.nan_to_num(n0 * n1 * (s0 / n0 - (s0[-1] - s0) / n1) ** 2)
    return centre[np.argmax(np.round(between, 6))]


def picture(seed):
    """Patches of one colour with noise, some of them dark and blue."""
    rng = np.random.default_rng(seed)
    rgb = np.zeros((H, W, 3), int)
    colours = [(20, 22, 70), (60, 140, 50), (90, 92, 91), (200, 198, 190), (40, 60, 160), (120, 110, 90)]
    for y in range(0, H, 9):
        for x in range(0, W, 8):
            rgb[y : y + 9, x : x + 8] = colours[rng.integers(len(colours))]
    rough = np.repeat(np.repeat(rng.integers(0, 2, (3, 4)), 9, 0), 8, 1)[:H, :W]
    return np.clip(rgb + rng.integers(-12, 13, rgb.shape) * rough[..., None], 0, 255), rng


def frame(spark, rgb, **more):
    rows = [(7, y, x, *map(int, rgb[y, x]), *(v[y, x].item() for v in more.values())) for y in range(H) for x in range(W)]
    kinds = {"b": "boolean", "f": "double", "i": "int"}
    schema = "scene_id int, row int, col int, r int, g int, b int" + "".join(f", {k} {kinds[v.dtype.kind]}" for k, v in more.items())
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed,most,least", [(1, 0.35, 30), (2, 0.05, 4), (3, 0.35, 1)])
def test_detect_shadow(spark, seed, most, least):
    rgb, rng = picture(seed)
    sem = np.repeat(np.repeat(rng.integers(0, 5, (3, 4)), 9, 0), 8, 1)[:H, :W]
    a = rgb / 255.0
    lum, whole = 0.299 * a[..., 0] + 0.587 * a[..., 1] + 0.114 * a[..., 2], 299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2]
    hue = np.arctan2(a[..., 2], np.maximum(np.maximum(a[..., 0], a[..., 1]), 1e-6))
    index = (hue - hue.min()) / max(np.ptp(hue), 1e-6) * (1 - lum)
    m = (index > otsu(index.ravel())) & (whole < np.quantile(whole, 0.30)) & (sem != scenery.WATER)
    if m.mean() > most:
        m &= whole < np.quantile(whole, most)
    want = {p for part in components(closed(opened(m, 1), 2)) if len(part) >= least for p in part}
    got = scenery.detect_shadow(frame(spark, rgb, sem=sem), H, W, least=least, most=most)
    assert {(r["row"], r["col"]) for r in got.collect()} == want
    if seed == 3:
        assert want


@pytest.mark.parametrize("seed", [4, 5])
def test_segment_heuristic(spark, seed):
    rgb, rng = picture(seed)
    up, shade = rng.random((H, W)) * 4 // 1 + np.repeat(np.repeat(rng.integers(0, 4, (3, 4)), 9, 0), 8, 1)[:H, :W] * 2.0, rng.random((H, W)) < 0.2
    a = rgb / 255.0
    r, g, b = a[..., 0], a[..., 1], a[..., 2]
    lum, whole = 0.299 * r + 0.587 * g + 0.114 * b, 299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2]
    total, top = np.maximum(r + g + b, 1e-6), a.max(2)

    def mean(v, n):
        p = np.pad(v, n // 2, mode="symmetric")
        return np.mean([p[y : y + H, x : x + W] for y in range(n) for x in range(n)], axis=0)

    tex = np.round(np.sqrt(np.maximum(mean((lum - mean(lum, 7)) ** 2, 7), 0)), 9)
    veg = (2 * g - r - b) / total > 0.06
    water = closed(opened(((2 * b - r - g) / total > 0.05) & (tex < np.quantile(tex, 0.35)) & ~veg, 2), 4)
    ground = ~veg & ~water
    road = opened(ground & ((top - a.min(2)) / np.maximum(top, 1e-6) < 0.20) & (whole < np.quantile(whole[ground], 0.55)) & (tex < np.quantile(tex, 0.45)), 1)
    for built, heights in (((up > 2.5) & ~water & ~veg, "up"), (ground & (whole > np.quantile(whole[ground], 0.78)) & (tex > np.quantile(tex, 0.55)), None)):
        want = np.zeros((H, W), int)
        for code, m in ((scenery.VEGETATION, veg), (scenery.WATER, water), (scenery.ROAD, road), (scenery.BUILDING, closed(opened(built, 1), 2))):
            want[m] = code
        near = np.pad(want, 4, mode="symmetric")
        filled = np.array([[int(np.median(near[y : y + 9, x : x + 9])) for x in range(W)] for y in range(H)])
        got = scenery.segment_heuristic(frame(spark, rgb, up=up, shade=shade), H, W, heights, "shade").collect()
        assert {(x["row"], x["col"]): x["cover"] for x in got} == {(y, x): np.where(shade, filled, want)[y, x] for y in range(H) for x in range(W)}
        assert len(np.unique(want)) >= 3


@pytest.mark.parametrize("size", [6, 7])
def test_prominence(spark, size):
    z = np.random.default_rng(size).integers(0, 1000, (H, W)) / 8.0
    px = spark.createDataFrame([(1, y, x, float(z[y, x])) for y in range(H) for x in range(W)], "scene_id int, row int, col int, z double")
    p = np.pad(z, size, mode="symmetric")
    low = lambda y, x: np.sort(p[y + size - size // 2 : y + 2 * size - size // 2, x + size - size // 2 : x + 2 * size - size // 2].ravel())[size * size // 10]
    got = {(r["row"], r["col"]): r["prominence"] for r in scenery.prominence(px, "z", H, W, size, tile=10).collect()}
    assert got == {(y, x): z[y, x] - low(y, x) for y in range(H) for x in range(W)}


def test_shadow_of_one_building(spark):
    """A block of 6 x 6 with the sun in the south casts its height northwards: row numbers fall."""
    pixel = lambda rows, cols: spark.createDataFrame([(1, y, x, 5) for y in rows for x in cols], "scene_id int, row int, col int, component int")
    block, dark = pixel(range(16, 22), range(10, 16)), pixel(range(6, 16), range(10, 16)).filter("row <> 12")
    runs = scenery.shadow_runs(block, block, dark, 180.0, H, W, 40)
    assert {(r["row"], r["col"], r["length"]) for r in runs.collect()} == {(16, x, 10) for x in range(10, 16)}
    (anchor,) = scenery.harvest_shadow(block, block, dark, 180.0, 45.0, 0.5, H, W).collect()
    assert math.isclose(anchor["height_m"], 5.0) and anchor["weight"] == 1.0 and (anchor["row"], anchor["col"], anchor["ref_row"], anchor["ref_col"]) == (18, 12, 14, 13)
    assert scenery.harvest_shadow(block, block, dark.filter(F.lit(False)), 180.0, 45.0, 0.5, H, W).count() == 0


def test_select_buildings(spark):
    """Two squares joined by a line are two pieces (a line has no cells); a low square and a small one are refused."""
    blocks = [(1, 0, 0, 8, 8), (1, 3, 8, 1, 4), (1, 0, 12, 8, 8), (2, 14, 0, 8, 8), (3, 14, 14, 4, 4)]
    own = sorted({(9, y, x, k) for k, y0, x0, h, w in blocks for y in range(y0, y0 + h) for x in range(x0, x0 + w)})
    tall = {(y, x): 10.0 + (x >= 12) * 5 for _, y, x, k in own if k == 1} | {(y, x): 20.0 for _, y, x, k in own if k == 3}
    pixels = spark.createDataFrame(own, "scene_id int, row int, col int, instance int")
    px = spark.createDataFrame([(9, y, x, 0, tall.get((y, x), 1.0)) for y in range(H) for x in range(W)], "scene_id int, row int, col int, sem int, z double")
    got = scenery.select_buildings(pixels, px, "z", H, W).orderBy("building").collect()
    assert [(r["building"], r["instance"], r["n_px"], r["roof_m"], r["height_m"]) for r in got] == [(1, 1, 64, 10.0, 9.0), (2, 1, 64, 15.0, 14.0)]
