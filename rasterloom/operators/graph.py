"""Connected components of edge tables and of pixel masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.session import written, written_pixels

#: Edges that one call of ``least_linked`` sees, and bits of an id within its block.
CHUNK, BLOCK_BITS = 1 << 18, 12


def least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the edges (a, b), and for each the least id that these edges lead to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            return ids, ids[parent]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def forest(edges: DataFrame) -> DataFrame:
    """a, b: the ids of each chunk of edges (a, b) and the least id that the chunk leads to from them; an id has one row for each chunk that holds it.

    Edges between two blocks of ids meet in one task, in order, so that chunks share few ids where
    neighbours have near ids (pixels, meshes).
    """

    def shrink(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in parts:
            held.append(pdf)
            n += len(pdf)
            if n >= CHUNK:
                yield trees(held)
                held, n = [], 0
        if held:
            yield trees(held)

    def trees(held: list[pd.DataFrame]) -> pd.DataFrame:
        ids, least = least_linked(*(np.concatenate([pdf[c].to_numpy() for pdf in held]) for c in "ab"))
        return pd.DataFrame({"a": ids, "b": least})

    kind = edges.schema["a"].dataType.simpleString()
    near = edges.select("a", "b").repartition(F.shiftright("a", BLOCK_BITS), F.shiftright("b", BLOCK_BITS)).sortWithinPartitions("a")
    return near.mapInPandas(shrink, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """id and label, the least id reachable, for every id in ``edges`` (a, b).

    Edges become trees of one level within chunks first (``forest``), so only trees that share an
    id go on. Their roots alternate two steps on directed edges (child, parent). Large step: every greater neighbour of
    a node is joined to the least of all its neighbours. Small step: a node and its lesser
    neighbours are joined to the least of these. Each shortens paths whatever their numbering, so
    the rounds grow as the logarithm of the longest path; the edges never grow in number. It ends
    when every edge points to a node without a parent of its own, and no node has two. Least
    values are aggregated before edges move, so a node of many neighbours is no large group.
    """
    a, b = F.col("a"), F.col("b")
    first = written(forest(edges), "forest")
    nodes = first.groupBy(a.alias("id")).agg(F.min("b").alias("root"))
    # An id in several trees links their roots; it has at most one row a chunk.
    links = first.withColumn("m", F.min("b").over(W.partitionBy("a"))).filter("b > m")
    now = written(links.select(b.alias("a"), F.col("m").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return nodes.select("id", F.col("root").alias("label"))
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, a == F.col("u")).filter(b > a).select(b.alias("a"), F.col("m").alias("b"))
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(root.withColumnRenamed("a", "u"), a == F.col("u")).select(b.alias("a"), F.col("m").alias("b")).filter(a != b)
        now = written(down.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "edges")
        ends = now.select(a.alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(b.alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    return nodes.join(now.hint("merge"), F.col("root") == a, "left").select("id", F.coalesce("b", "root").alias("label"))


def labelled_runs(mask: DataFrame, key: str) -> DataFrame:
    """scene_id, key, row, col and ``component`` of 4-connected pixels of the same ``key``, which may overlap others'; labels are numbers of their first runs.

    As ``connected_components``, with a table of runs numbered by hash partition instead of place.
    """
    along = W.partitionBy("scene_id", key, "row").orderBy("col")
    numbered = mask.select("scene_id", key, "row", "col").distinct().withColumn("run", F.col("col") - F.row_number().over(along))
    runs = numbered.groupBy("scene_id", key, "row", "run").agg(F.min("col").alias("first"), F.max("col").alias("last"))
    runs = written_pixels(runs.sortWithinPartitions("scene_id", key, "row", "first").withColumn("id", F.monotonically_increasing_id()), "runs")
    cells = runs.select("scene_id", key, "row", "id", F.explode(F.sequence("first", "last")).alias("col"))
    below = cells.select("scene_id", key, (F.col("row") - 1).alias("row"), F.col("id").alias("b"), "col")
    edges = cells.withColumnRenamed("id", "a").join(below, ["scene_id", key, "row", "col"]).select("a", "b").distinct()
    label = components(edges.union(runs.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    # The component's name: the place of its first run within the key, so that it doesn't hang on partitions.
    named = runs.join(label, "id")
    first = named.groupBy("label").agg(F.min(F.col("row").cast("long") * (1 << 31) + F.col("first")).alias("component"))
    return named.join(first, "label").select("scene_id", key, "row", F.explode(F.sequence("first", "last")).alias("col"), "component").hint("merge")


def connected_components(mask: DataFrame, width: int, least: int = 1) -> DataFrame:
    """scene_id, row, col and ``component`` of 4-connected pixels; components of under ``least`` pixels are left out.

    ``mask`` holds the set pixels. Pixels first become runs along rows; only runs and their
    overlaps in neighbouring rows go through the rounds of labelling. The label is the least
    (scene, row, col) of the component as one number.
    """
    along = W.partitionBy("scene_id", "row").orderBy("col")
    numbered = mask.select("scene_id", "row", "col").withColumn("run", F.col("col") - F.row_number().over(along))
    runs = numbered.groupBy("scene_id", "row", "run").agg(F.min("col").alias("first"), F.max("col").alias("last"))
    place = lambda row, col: (F.col("scene_id").cast("long") * 1_000_000_000_000 + F.col(row).cast("long") * width + F.col(col)).alias("id")
    runs = written_pixels(runs.select("scene_id", "row", "run", "first", "last", place("row", "first")), "runs")
    # Overlap by equal column, so that a row of many runs meets the next through its pixels.
    cells = runs.select("scene_id", "row", "id", F.explode(F.sequence("first", "last")).alias("col"))
    below = cells.select("scene_id", (F.col("row") - 1).alias("row"), F.col("id").alias("b"), "col")
    edges = cells.withColumnRenamed("id", "a").join(below, ["scene_id", "row", "col"]).select("a", "b").distinct()
    label = components(edges.union(runs.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    named = runs.join(label, "id").withColumnRenamed("label", "component")
    size = named.groupBy(F.col("component").alias("c")).agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).filter(F.col("n") >= least)
    kept = named.join(size, F.col("component") == F.col("c"), "left_semi")
    # Spark takes pixels for as few as their runs, and would broadcast them.
    return kept.select("scene_id", "row", F.explode(F.sequence("first", "last")).alias("col"), "component").hint("merge")
