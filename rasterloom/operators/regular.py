"""Building outlines: traced rings are thinned, take a map's shape where one agrees, and are squared up, or say why not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import footprints, joins, outlines

#: Tolerance of thinning and largest move of a corner in metres, share of area that may change, corners that a shape needs, overlap that a map's shape needs.
TOLERANCE_M, MOST_SHIFT_M, MOST_AREA, LEAST_CORNERS, LEAST_IOU = 0.6, 2.5, 0.12, 4, 0.5


def to_polyline(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each of ``points`` to the nearest of the segments from ``a`` to ``b`` (complex numbers)."""
    along = np.where(a == b, 1, b - a)
    share = np.clip(((points[:, None] - a) * along.conj()).real / np.abs(along) ** 2, 0, 1)
    return np.abs(points[:, None] - (a + share * (b - a))).min(1)


def thinned(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker from the first point to the last: no point left out is farther than ``tolerance`` from what is kept. Under four points the ring stays."""
    kept, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        far = to_polyline(ring[i + 1 : j], ring[i : i + 1], ring[j : j + 1])
        k = i + 1 + int(far.argmax())
        if far[k - i - 1] > tolerance:
            kept.add(k)
            todo += [(i, k), (k, j)]
    return ring[sorted(kept)] if len(kept) >= LEAST_CORNERS else ring


def area_of(ring: np.ndarray) -> float:
    return abs(float((ring.conj() * np.roll(ring, -1)).imag.sum())) / 2


def axis_of(ring: np.ndarray) -> float:
    """The direction, modulo a right angle, that the sides follow, long ones most: fourfold angles are added as vectors of the sides' lengths."""
    side = np.roll(ring, -1) - ring
    side = side[np.abs(side) > 1e-9]
    return float(np.angle((side**4 / np.abs(side) ** 3).sum()) / 4 % (np.pi / 2))


def squared(ring: np.ndarray) -> tuple[np.ndarray | None, float, str | None]:
    """(ring, axis, refusal): the ring with sides along and across its axis only.

    Neighbouring sides of one direction are one line, at the mean of their middles by length, and
    lines meet in corners.
    """
    if len(ring) < LEAST_CORNERS:
        return None, 0.0, "fewer than four vertices to work with"
    axis = axis_of(ring)
    own = ring * np.exp(-1j * axis)
    nxt = np.roll(own, -1)
    side = nxt - own
    level = np.abs(side.real) >= np.abs(side.imag)
    new = np.flatnonzero(level != np.roll(level, 1))
    n_lines = max(len(new), 1)
    if n_lines < LEAST_CORNERS:
        return None, axis, f"only {n_lines} alternating sides after merging; not a rectilinear outline"
    # Sides in the order of lines, the first line starting where the direction first changes.
    order = np.roll(np.arange(len(own)), -new[0])
    line = np.cumsum(np.isin(order, new)) - 1
    middle, length = ((own + nxt) / 2)[order], np.abs(side)[order]
    place = np.where(level[order], middle.imag, middle.real)
    total = np.bincount(line, length)
    at = np.where(total > 0, np.bincount(line, length * place) / np.where(total > 0, total, 1), np.bincount(line, place) / np.bincount(line))
    flat = level[new]
    after = np.roll(at, -1)
    corners = np.where(flat, after + 1j * at, at + 1j * after)
    return corners * np.exp(1j * axis), axis, None


def outline_of(ring: np.ndarray, gsd: float, shape: np.ndarray | None, iou: float | None, tolerance: float, most_area: float, most_shift: float, least_iou: float, square: bool) -> dict:
    """The stage that a traced ring (x + iy) reaches, its points, and why others refused; ``shape`` is a map's outline to adopt, ``iou`` the best overlap with one."""
    whole, refused = area_of(ring), []
    out = {"stage": "traced", "vertices_in": len(ring) + 1, "area_change": 0.0, "max_shift_m": 0.0, "angle_deg": None, "iou": iou}
    own = thinned(ring, tolerance / gsd)
    if len(own) >= LEAST_CORNERS:
        out["stage"] = "simplified"
    if shape is not None:
        own, out["stage"] = shape, "osm"
    elif iou:
        refused.append(f"the best OSM footprint overlaps at IoU {iou:.2f}, under the {least_iou:.2f} needed to adopt its shape")
    if square:
        corners, axis, why = squared(own)
        if why:
            refused.append(why)
        else:
            change = abs(area_of(corners) - whole) / max(whole, 1e-9)
            shift = float(to_polyline(corners, own, np.roll(own, -1)).max()) * gsd
            if change > most_area:
                refused.append(f"squaring it up would change the footprint area by {change * 100:.1f}%, over the {most_area * 100:.0f}% limit")
            elif shift > most_shift:
                refused.append(f"squaring it up would move a corner by {shift:.1f} m, over the {most_shift:.1f} m limit")
            else:
                own = corners
                out |= {"stage": "regular", "area_change": change, "max_shift_m": shift, "angle_deg": float(np.degrees(axis))}
    return out | {"vertices_out": len(own), "refused": refused, "pts": [{"y": float(p.imag), "x": float(p.real)} for p in own]}


def regular_outlines(
    mask_px: DataFrame, h: int, w: int, gsd: float, polygons: DataFrame | None = None, tolerance: float = TOLERANCE_M, most_area: float = MOST_AREA, most_shift: float = MOST_SHIFT_M,
    least_iou: float = LEAST_IOU, square: bool = True,
) -> DataFrame:
    """scene_id, mask_id, stage (traced, simplified, osm or regular), vertices in and out, area_change, max_shift_m, angle_deg, iou, refused and ``pts`` (y, x; at pixel centres).

    The longest ring of each mask is traced through the middles of its edges, thinned to
    ``tolerance`` metres, replaced by the footprint of ``polygons`` (scene_id, feature_id, pts) that
    overlaps it most, if that reaches ``least_iou``, and squared up, unless that changes its area
    or moves a corner too much. Each stage that refuses says so; no mask is dropped. A task holds
    one ring at a time.
    """
    edges = outlines.link_rings(outlines.boundary_edges(mask_px, w + 1))
    middle = F.struct("pos", ((F.col("y") + F.col("to_y") - 1) / 2).alias("y"), ((F.col("x") + F.col("to_x") - 1) / 2).alias("x"))
    rings = edges.groupBy("scene_id", "mask_id", "ring").agg(F.count("*").alias("n_edges"), F.sort_array(F.collect_list(middle)).alias("line"))
    own = outlines.longest_outline(rings).select("scene_id", "mask_id", F.transform("line", lambda p: p["y"]).alias("ys"), F.transform("line", lambda p: p["x"]).alias("xs"))
    none = F.lit(None)
    if polygons is None:
        own = own.withColumns({"iou": none.cast("double"), "sy": none.cast("array<double>"), "sx": none.cast("array<double>")})
    else:
        best = footprints.best_overlap(mask_px, joins.fill_polygon(polygons, h, w), least_iou).withColumnRenamed("feature_id", "_f")
        shapes = polygons.select(F.col("scene_id").alias("_s"), F.col("feature_id").alias("_p"), F.transform("pts", lambda p: p["y"].cast("double")).alias("sy"), F.transform("pts", lambda p: p["x"].cast("double")).alias("sx"))
        own = own.join(best, ["scene_id", "mask_id"], "left").join(shapes, (F.col("scene_id") == F.col("_s")) & (F.col("_f") == F.col("_p")), "left").drop("_s", "_p", "_f").na.fill(0.0, ["iou"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                shape = None if r.sy is None else np.asarray(r.sx) + 1j * np.asarray(r.sy)
                if shape is not None and len(shape) > 1 and shape[0] == shape[-1]:
                    shape = shape[:-1]
                iou = None if r.iou is None or np.isnan(r.iou) else float(r.iou)
                found = outline_of(np.asarray(r.xs) + 1j * np.asarray(r.ys), gsd, shape, iou, tolerance, most_area, most_shift, least_iou, square)
                rows.append({"scene_id": r.scene_id, "mask_id": r.mask_id} | found)
            yield pd.DataFrame(rows, columns=names)

    kinds = {c: own.schema[c].dataType.simpleString() for c in ("scene_id", "mask_id")}
    kinds |= {"stage": "string", "vertices_in": "int", "vertices_out": "int", "area_change": "double", "max_shift_m": "double", "angle_deg": "double", "iou": "double", "refused": "array<string>", "pts": "array<struct<y: double, x: double>>"}
    names = list(kinds)
    return own.mapInPandas(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))
