"""Mask proposals from a user's function over overlapping chips."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import mosaic
from rasterloom.session import written

#: (mask over the chip, predicted IoU, stability) of each proposal of a chip.
Proposals = Iterable[tuple[np.ndarray, float, float]]
#: What each worker has loaded, by call of ``mask_source``.
_LOADED: dict[str, Callable[[np.ndarray], Proposals]] = {}


def _finder(key: str, load: Callable[[], Callable[[np.ndarray], Proposals]]) -> Callable[[np.ndarray], Proposals]:
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def mask_source(
    px: DataFrame, bands: tuple[str, ...], h: int, w: int, load: Callable[[], Callable[[np.ndarray], Proposals]], chip: int = 1024, overlap: float = 0.25,
    iou: float = 0.55, stability: float = 0.75, least: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """(records, pixels): masks that a user's function finds on chips, and their pixels (scene_id, mask_id, row, col).

    ``load`` is called once in each worker and returns the function, which gets (h, w, bands)
    bytes. Proposals under ``iou``, ``stability`` or ``least`` pixels are left out; a mask of
    another shape than its chip is an error. records: scene_id, mask_id, chip corner, iou,
    stability, area_px and the inclusive box y0, x0, y1, x1 in the raster, as ``box_nms`` and
    ``paint_instances`` take them. Absent pixels are 0 to the function and in no mask.
    """
    inputs = [f"_band{k}" for k in range(len(bands))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        find = _finder(key, load)
        r, c = int(pdf["r"].iloc[0]), int(pdf["c"].iloc[0])
        shape = (min(chip, h - r), min(chip, w - c))
        image, there = np.zeros((*shape, len(bands)), np.uint8), np.zeros(shape, bool)
        y, x = pdf["row"].to_numpy() - r, pdf["col"].to_numpy() - c
        image[y, x], there[y, x] = pdf[inputs].to_numpy(), True
        rows = []
        for mask, own_iou, own_stability in find(image):
            mask = np.asarray(mask, bool)
            if mask.shape != shape:
                raise ValueError(f"the function gave a mask of {mask.shape} for a chip of {shape}")
            at = np.nonzero(mask & there)
            if own_iou >= iou and own_stability >= stability and len(at[0]) >= least:
                rows.append((pdf["scene_id"].iloc[0], r, c, float(own_iou), float(own_stability), at[0] + r, at[1] + c))
        return pd.DataFrame(rows, columns=["scene_id", "r", "c", "iou", "stability", "rows", "cols"])

    key = uuid.uuid4().hex
    own = mosaic.chip_windows(px.select("scene_id", "row", "col", *(F.col(b).alias(n) for b, n in zip(bands, inputs, strict=True))), h, w, chip, overlap)
    kind = px.schema["scene_id"].dataType.simpleString()
    found = own.groupBy("scene_id", "r", "c").applyInPandas(run, f"scene_id {kind}, r int, c int, iou double, stability double, rows array<int>, cols array<int>")
    found = written(found.withColumn("mask_id", F.monotonically_increasing_id()), "proposals")
    ends = {"y0": F.array_min("rows"), "x0": F.array_min("cols"), "y1": F.array_max("rows"), "x1": F.array_max("cols")}
    records = found.select("scene_id", "mask_id", "r", "c", "iou", "stability", F.size("rows").alias("area_px"), *(v.alias(k) for k, v in ends.items()))
    pixels = found.select("scene_id", "mask_id", F.explode(F.arrays_zip("rows", "cols")).alias("p")).select("scene_id", "mask_id", F.col("p.rows").alias("row"), F.col("p.cols").alias("col"))
    return records, pixels
