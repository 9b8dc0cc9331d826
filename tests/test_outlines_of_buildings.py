"""Outlines that are thinned, adopted and squared up, and proposals of masks by a user's function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import footprints, instances, joins, proposals, regular

S = 90


def turned(angle, sides, holes=()):
    """A mask of the union of boxes (u0, u1, v0, v1) about the middle, turned by ``angle`` degrees."""
    row, col = np.mgrid[0:S, 0:S] - S / 2 + 0.31
    t = np.radians(angle)
    u, v = col * np.cos(t) + row * np.sin(t), -col * np.sin(t) + row * np.cos(t)
    box = lambda b: (u >= b[0]) & (u <= b[1]) & (v >= b[2]) & (v <= b[3])
    return np.any([box(b) for b in sides], 0) & ~np.any([box(b) for b in holes] or [np.zeros((S, S), bool)], 0)


ANGLES = (0, 17, 30, 45, 63)
ELL = [(-25, 25, -20, 0), (-25, -5, -20, 22)]


def masks():
    row, col = np.mgrid[0:S, 0:S] - S / 2
    out = [turned(a, [(-26, 26, -14, 14)]) for a in ANGLES]
    out += [turned(20, ELL), row**2 + col**2 <= 30**2, turned(0, [(-26, 26, -14, 14)], [(-5, 5, -5, 5)]), turned(0, [(0, 1, 0, 1)])]
    return out


def pixels(spark, own):
    return spark.createDataFrame([(0, k, int(r), int(c)) for k, m in enumerate(own) for r, c in zip(*np.nonzero(m), strict=True)], "scene_id int, mask_id int, row int, col int")


def test_thinning_keeps_its_promise():
    rng = np.random.default_rng(1)
    for n in (4, 30, 400):
        ring = np.cumsum(rng.normal(size=n) + 1j * rng.normal(size=n))
        for tolerance in (0.0, 0.5, 3.0):
            thin = regular.thinned(ring, tolerance)
            assert set(thin) <= set(ring) and thin[0] == ring[0] and thin[-1] == ring[-1]
            assert regular.to_polyline(ring, thin[:-1], thin[1:]).max() <= tolerance + 1e-9 or len(thin) == n


def test_axes_of_turned_rectangles():
    for angle in (0.0, 1.0, 44.0, 46.0, 89.0):
        ring = np.array([0, 10, 10 + 4j, 4j]) * np.exp(1j * np.radians(angle))
        assert abs(np.degrees(regular.axis_of(ring)) - angle) < 1e-9
        corners, _, why = regular.squared(ring)
        assert why is None and np.allclose(sorted(corners, key=lambda z: (round(z.real, 6), round(z.imag, 6))), sorted(ring, key=lambda z: (round(z.real, 6), round(z.imag, 6))))
    assert regular.squared(np.array([0, 1, 1j]))[2] == "fewer than four vertices to work with"
    assert regular.squared(np.exp(1j * np.array([0, 0.2, 0.3, 0.4])))[2].startswith("only ")


def test_buildings_become_rectilinear_and_round_ones_refuse(spark):
    own = masks()
    got = {r["mask_id"]: r for r in regular.regular_outlines(pixels(spark, own), S, S, 0.5).collect()}
    assert set(got) == set(range(len(own)))
    for k, angle in enumerate(ANGLES):
        r = got[k]
        assert r["stage"] == "regular" and r["vertices_out"] == 4 and r["vertices_in"] > 100 and not r["refused"]
        off = abs(r["angle_deg"] - angle) % 90
        assert min(off, 90 - off) < 2 and r["area_change"] < 0.12 and r["max_shift_m"] < 2.5
    assert got[5]["stage"] == "regular" and got[5]["vertices_out"] == 6
    # A circle squared up would lose its shape; it stays thinned and says why.
    assert got[6]["stage"] == "simplified" and len(got[6]["refused"]) == 1 and "squar" in got[6]["refused"][0] or "alternating" in got[6]["refused"][0]
    assert got[6]["vertices_out"] < got[6]["vertices_in"] / 4
    # The courtyard's ring is the shorter one and is dropped.
    assert got[7]["vertices_out"] == 4 and min(got[7]["angle_deg"], 90 - got[7]["angle_deg"]) < 2
    assert got[8]["vertices_in"] >= 4 and got[8]["pts"]
    # Back to pixels, the outlines cover what they came from.
    polygons = spark.createDataFrame([(0, k, [(p["y"], p["x"]) for p in r["pts"]]) for k, r in got.items() if k < 7], "scene_id int, feature_id int, pts array<struct<y: double, x: double>>")
    back = {}
    for r in joins.fill_polygon(polygons, S, S).collect():
        back.setdefault(r["feature_id"], np.zeros((S, S), bool))[r["row"], r["col"]] = True
    for k in range(7):
        assert (back[k] & own[k]).sum() / (back[k] | own[k]).sum() > 0.93, k
    plain = {r["mask_id"]: r["stage"] for r in regular.regular_outlines(pixels(spark, own), S, S, 0.5, square=False).collect()}
    assert set(plain.values()) <= {"simplified", "traced"} and plain[0] == "simplified"


def test_maps_give_their_shape_where_they_agree(spark):
    own = [turned(0, [(-26, 26, -14, 14)]), turned(17, [(-26, 26, -14, 14)]), turned(30, [(-26, 26, -14, 14)])]
    rings = [(0, 1, [(30.5, 18.5), (30.5, 71.5), (58.5, 71.5), (58.5, 18.5), (30.5, 18.5)]), (0, 2, [(0.0, 0.0), (0.0, 40.0), (40.0, 40.0), (40.0, 0.0)])]
    polygons = spark.createDataFrame(rings, "scene_id int, feature_id int, pts array<struct<y: double, x: double>>")
    got = {r["mask_id"]: r for r in regular.regular_outlines(pixels(spark, own), S, S, 0.5, polygons, square=False).collect()}
    assert got[0]["stage"] == "osm" and got[0]["iou"] > 0.9 and got[0]["vertices_out"] == 4
    # Some masks agree enough with the first footprint as well; those under the bar say how far they are.
    for k in (1, 2):
        if got[k]["iou"] >= 0.5:
            assert got[k]["stage"] == "osm"
        else:
            assert got[k]["stage"] == "simplified" and got[k]["refused"][0].startswith(f"the best OSM footprint overlaps at IoU {got[k]['iou']:.2f}")
    strict = {r["mask_id"]: r for r in regular.regular_outlines(pixels(spark, own), S, S, 0.5, polygons, least_iou=0.99).collect()}
    assert strict[0]["stage"] == "regular" and strict[0]["refused"] == [f"the best OSM footprint overlaps at IoU {strict[0]['iou']:.2f}, under the 0.99 needed to adopt its shape"]


def test_proposals_are_filtered_and_feed_the_others(spark):
    def halves():
        """Loaded in a worker: proposals for the bright pixels, and some that are refused."""

        def find(image):
            bright = image[..., 0] > 100
            few = np.zeros(bright.shape, bool)
            few[0, :3] = True
            return [(bright, 0.9, 0.9), (bright, 0.5, 0.9), (bright, 0.9, 0.7), (few, 0.9, 0.9)]

        return find

    px = spark.createDataFrame([(s, r, c, 200 if 4 <= r < 14 and 5 + s <= c < 17 else 10) for s in (0, 1) for r in range(20) for c in range(34)], "scene_id int, row int, col int, r int")
    records, found = proposals.mask_source(px, ("r",), 20, 34, halves, 20, 0.3)
    got = records.orderBy("scene_id", "c").collect()
    assert [(r["scene_id"], r["r"], r["c"], r["area_px"], r["y0"], r["x0"], r["y1"], r["x1"]) for r in got] == [(0, 0, 0, 120, 4, 5, 13, 16), (1, 0, 0, 110, 4, 6, 13, 16)]
    assert records.select("mask_id").distinct().count() == 2 and found.count() == 230
    low, _ = proposals.mask_source(px, ("r",), 20, 34, halves, 20, 0.3, least=20)
    # The next chip sees the last columns again; suppression keeps the larger of both.
    assert low.count() == 4
    boxes = low.select("scene_id", "mask_id", "y0", "x0", (F.col("y1") + 1).alias("y1"), (F.col("x1") + 1).alias("x1"), F.col("area_px").cast("double").alias("score"), "area_px")
    assert footprints.box_nms(boxes, 0.2).count() == 2
    assert instances.paint_instances(found)[0].count() == 2
    with pytest.raises(Exception, match="the function gave a mask of"):
        proposals.mask_source(px, ("r",), 20, 34, lambda: lambda image: [(np.ones((2, 2)), 1.0, 1.0)], 20)[0].count()
