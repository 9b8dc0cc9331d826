"""Outlines of masks: directed boundary edges, linked into rings by pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators import footprints
from rasterloom.session import written_pixels as written

#: Edges that one call links, bits of a row within its band, and bits of an edge's number below that of its mask.
CHUNK, BAND_BITS, EDGE_BITS = 1 << 18, 8, 44


def boundary_edges(mask_px: DataFrame, width: int, key: str = "mask_id") -> DataFrame:
    """scene_id, key, edge, prev, x, y, to_x, to_y and ``corner`` of the sides of pixels that have no pixel of their mask beyond, each after the one before it on its ring.

    Sides run with the mask on their right (rows down), from (x, y) to (to_x, to_y) on the lattice
    of pixel corners; ``corner`` says whether the ring turns at (x, y). Where two pixels meet at a
    corner alone, rings stay with their pixel, so pieces joined by corners have rings of their own.
    A pixel's neighbours are looked up along its row and its column, so only sides of the boundary
    move on, and a lattice point joins at most two sides that end with two that start.
    """
    line = mask_px.groupBy("scene_id", key, "row").agg(F.sort_array(F.collect_set("col")).alias("cols"))
    own = line.select("scene_id", key, "row", "cols", F.posexplode("cols").alias("at", "col"))
    beside = lambda k: F.coalesce(F.get("cols", F.col("at") + k) == F.col("col") + k, F.lit(False))
    own = own.select("scene_id", key, "row", "col", beside(1).alias("right"), beside(-1).alias("left"))
    down = W.partitionBy("scene_id", key, "col").orderBy("row")
    over, under = F.coalesce(F.lag("row").over(down) == F.col("row") - 1, F.lit(False)), F.coalesce(F.lead("row").over(down) == F.col("row") + 1, F.lit(False))
    own = own.withColumns({"over": over, "under": under})
    pixel = F.col("row").cast("long") * width + F.col("col")
    r, c = F.col("row").cast("int"), F.col("col").cast("int")
    corner = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]

    def side(k: int, beyond: str):
        (y0, x0), (y1, x1) = corner[k], corner[(k + 1) % 4]
        return F.when(~F.col(beyond), F.struct((pixel * 4 + k).alias("edge"), y0.alias("y"), x0.alias("x"), y1.alias("to_y"), x1.alias("to_x")))

    bare = F.array_compact(F.array(*(side(k, beyond) for k, beyond in enumerate(("over", "right", "under", "left")))))
    edges = own.select("scene_id", key, F.explode(bare).alias("e")).select("scene_id", key, "e.*")
    ends = F.array(
        F.struct(F.col("y").alias("py"), F.col("x").alias("px"), F.lit(False).alias("ends")), F.struct(F.col("to_y").alias("py"), F.col("to_x").alias("px"), F.lit(True).alias("ends"))
    )
    met = edges.select("scene_id", key, F.explode(ends).alias("p"), F.struct("edge", "y", "x", "to_y", "to_x").alias("e"))
    points = met.groupBy("scene_id", key, "p.py", "p.px").agg(F.collect_list(F.when(F.col("p.ends"), F.col("e.edge"))).alias("come"), F.collect_list(F.when(~F.col("p.ends"), F.col("e"))).alias("go"))
    same = lambda a, b: F.floor(a / 4) == F.floor(b / 4)
    e = F.col("e")
    prev = F.when(F.size("come") == 1, F.get("come", 0)).otherwise(F.get(F.filter("come", lambda a: same(a, e["edge"])), 0))
    linked = points.select("scene_id", key, "come", F.explode("go").alias("e")).withColumn("prev", prev)
    return linked.select("scene_id", key, "e.*", "prev", (F.col("prev") % 4 != e["edge"] % 4).alias("corner"))


def closed_rings(code: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges of rising number ``code``, each with the number of the edge before it: the place of the least edge of its ring and the steps from there, or -1 where the ring leads out of ``code``."""
    n = len(code)
    at = np.minimum(np.searchsorted(code, before), n - 1)
    # Place n stands for all edges elsewhere; it is less than any, so it spreads over open rings.
    back = np.append(np.where(code[at] == before, at, n), n)
    least, steps, reach = np.append(np.arange(n), -1), np.zeros(n + 1, np.int64), 1
    while (less := least[back] < least).any():
        steps = np.where(less, reach + steps[back], steps)
        least = np.where(less, least[back], least)
        back, reach = back[back], reach * 2
    return least[:n], steps[:n]


def link_rings(edges: DataFrame, key: str = "mask_id") -> DataFrame:
    """``edges`` with ``ring``, the least edge of the ring, and ``pos``, the steps from it on.

    Edges of a mask meet in one task by bands of rows, and rings that lie whole in a chunk of them
    are linked there. Only the others go through rounds: each looks twice as far back along the
    ring and carries the least edge seen and how far it lies, so there are as many rounds as the
    logarithm of the longest ring, and no mask is one group. It ends when no edge sees a lesser one.
    """

    def link(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in parts:
            held.append(pdf)
            n += len(pdf)
            if n >= CHUNK:
                yield linked(held)
                held, n = [], 0
        if held:
            yield linked(held)

    def linked(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        mask = pdf.groupby(["scene_id", key], sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf["edge"].to_numpy(), mask))
        pdf, mask = pdf.iloc[order].reset_index(drop=True), mask[order] << EDGE_BITS
        edge = pdf["edge"].to_numpy()
        least, steps = closed_rings(mask | edge, mask | pdf["prev"].to_numpy())
        whole = least >= 0
        return pdf.assign(ring=np.where(whole, edge[least], -1), pos=np.where(whole, steps, -1))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema) + ", ring bigint, pos bigint"
    near = edges.repartition("scene_id", key, F.shiftright("y", BAND_BITS)).sortWithinPartitions("scene_id", key)
    first = written(near.mapInPandas(link, kinds), "ring-edges")
    rest = first.filter("ring < 0").drop("ring", "pos")
    if rest.isEmpty():
        return first
    now = rest.select("scene_id", key, "edge", F.col("prev").alias("back"), F.least("edge", "prev").alias("ring"), F.when(F.col("prev") < F.col("edge"), 1).otherwise(0).cast("long").alias("pos"))
    reach = 1
    while True:
        then = now.select("scene_id", key, F.col("edge").alias("back"), F.col("back").alias("back2"), F.col("ring").alias("ring2"), F.col("pos").alias("pos2"))
        less = F.col("ring2") < F.col("ring")
        joined = now.join(then, ["scene_id", key, "back"])
        now = written(joined.select("scene_id", key, "edge", F.col("back2").alias("back"), F.least("ring", "ring2").alias("ring"), F.when(less, F.col("pos2") + reach).otherwise(F.col("pos")).alias("pos"), less.alias("less")), "rings")
        if now.filter("less").isEmpty():
            break
        reach *= 2
    late = rest.join(now.select("scene_id", key, "edge", "ring", "pos"), ["scene_id", key, "edge"])
    return first.filter("ring >= 0").unionByName(late)


def trace_outlines(mask_px: DataFrame, width: int, key: str = "mask_id") -> DataFrame:
    """scene_id, key, ring, n_edges, area and ``pts`` (x, y; corners of the lattice in order) of every ring of each mask.

    Areas are signed: rings around pixels count plus, rings around holes minus, so a mask's areas
    add up to its pixels. ``width`` exceeds every column. Masks without pixels have no ring.
    """
    rings = link_rings(boundary_edges(mask_px, width, key), key)
    cross = F.col("x").cast("long") * F.col("to_y") - F.col("to_x").cast("long") * F.col("y")
    turn = F.when(F.col("corner"), F.struct("pos", "x", "y"))
    out = rings.groupBy("scene_id", key, "ring").agg(F.count("*").alias("n_edges"), (F.sum(cross) / 2).alias("area"), F.sort_array(F.collect_list(turn)).alias("_p"))
    return out.select("scene_id", key, "ring", "n_edges", "area", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))


def longest_outline(rings: DataFrame, key: str = "mask_id") -> DataFrame:
    """The longest ring of each mask, ties by the least ring."""
    return footprints.largest(rings, ("scene_id", key), "n_edges", "ring")
