"""Near-duplicate documents by SimHash, found by counts of set bits in segments.

A fingerprint becomes the vector of the numbers of set bits of its 32 two-bit segments. One
changed bit moves one count by one, so the Manhattan distance of two vectors is at most the Hamming
distance of their fingerprints. Within a distance of MOST, at most MOST of MOST + 3 groups of
segments differ, so three agree: each choice of three groups is a grid whose cells are their
counts, and all of a point's range lies in its cells of these grids. Points that share a cell
are held against each other by Manhattan distance, then by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, texts, written
from rasterloom.operators.graph import components

WORDS, SEED = 3, 42
#: Fingerprints link at so many differing bits or fewer.
MOST = 3
#: Groups of segments that agree in a cell.
AGREE = 3
SEGMENTS = 32
#: Cells of more points are cut into blocks, of which each pair meets.
CELL, BLOCK = 512, 2048

_LOW = 0x5555555555555555


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text, as a signed number: bits set in over half the hashes of its shingles; 0 without words."""
    own = data.lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(own) - words + 1)
    last = ends[min(words, len(own)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        spans = zip(starts[at : min(n, at + 65536)].tolist(), last[at : min(n, at + 65536)].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _prints(text: str, key: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            own = [fingerprint(x, words) for x in texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(own, pa.int64())], [key, "print"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """``key`` and ``print``, the fingerprint of every whole text (A to Z lower-cased, words between white space, shingles with their repeats)."""
    return docs.select(key, text).mapInArrow(_prints(text, key, words), f"{key} {docs.schema[key].dataType.simpleString()}, print long")


def counts_of(bits: Column) -> Column:
    """The numbers of set bits of all two-bit segments, in the segments' own two bits."""
    low, high = bits.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def grids(most: int = MOST) -> list[int]:
    """The bits, as signed numbers, of the segments of each choice of AGREE groups of most + AGREE."""
    group = [sum(0b11 << (2 * s) for s in range(SEGMENTS) if s * (most + AGREE) // SEGMENTS == g) for g in range(most + AGREE)]
    masks = [sum(own) for own in combinations(group, AGREE)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def cells_of(points: DataFrame, most: int = MOST) -> DataFrame:
    """grid, cell and print: every point under its counts of each grid."""
    masks = F.array(*[F.lit(m).cast("long") for m in grids(most)])
    return points.select("print", counts_of(F.col("print")).alias("counts"), F.posexplode(masks).alias("grid", "mask")).select(
        "grid", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"), "print"
    )


def _close(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether fingerprints are within ``most`` bits: the counts' Manhattan distance first, then the bits of those that pass."""
    low = np.uint64(_LOW)
    count = lambda v: v - ((v >> np.uint64(1)) & low)
    moved = count(x) ^ count(y)
    odd, two = moved & low, (moved >> np.uint64(1)) & low
    # Counts that differ by one differ in their low bit, 0 and 2 in the high bit alone.
    fine = np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(two & ~odd).astype(np.int64) <= most
    fine[fine] = np.bitwise_count(x[fine] ^ y[fine]) <= most
    return fine


def _cell_links(most: int):
    """Links of points of one cell; rows come sorted by grid and cell, a cell may span batches and has at most CELL points."""

    def links(grid: np.ndarray, cell: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        at = np.arange(len(own))
        for d in range(1, len(own)):
            at = at[at + d < len(own)]
            at = at[(cell[at] == cell[at + d]) & (grid[at] == grid[at + d])]
            if not len(at):
                break
            fine = at[_close(own[at], own[at + d], most)]
            a.append(own[fine])
            b.append(own[fine + d])
        both = np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], 1)
        found = np.unique(np.sort(both, 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = [np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]]), np.concatenate([held[2], new[2].view(np.uint64)])]
            cut = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])).max(initial=-1)) + 1
            yield links(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        yield links(*held)

    return run


def forest(points: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs of ``points`` within ``most`` bits: each point is held against those not yet reached."""
    left = points.copy()
    out: list[tuple[int, int]] = []
    while len(left):
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            x = edge.pop()
            near = _close(np.full(len(left), x), left, most)
            if near.any():
                new = left[near]
                out.extend((int(x.view(np.int64)), int(y)) for y in new.view(np.int64))
                edge.extend(new)
                left = left[~near]
    return out


def block_links(members: DataFrame, most: int) -> DataFrame:
    """Links within large cells (grid, cell, print, count): blocks of about BLOCK points meet in pairs, and a task holds two of them."""
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    dealt = dealt.select("grid", "cell", "print", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("grid", "cell", "print", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(pdf["print"].to_numpy(np.int64).view(np.uint64), most), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("grid", "cell", "i", "j").applyInPandas(meet, "a long, b long")


def close_pairs(points: DataFrame, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``points`` (print, distinct) within ``most`` bits.

    Cells of at most ``cell`` points give all their links, larger ones a spanning forest of each
    pair of blocks. Only the counts of cells and the points themselves move.
    """
    rows = cells_of(points, most)
    sizes = written(rows.groupBy(F.col("grid").alias("g"), F.col("cell").alias("c")).count().filter(F.col("count") > 1), "cells")
    here = (F.col("grid") == F.col("g")) & (F.col("cell") == F.col("c"))
    small = rows.join(sizes.filter(F.col("count") <= cell), here, "left_semi")
    few = small.repartition("grid", "cell").sortWithinPartitions("grid", "cell").select("grid", "cell", "print").mapInArrow(_cell_links(most), "a long, b long")
    large = rows.join(sizes.filter(F.col("count") > cell), here).select("grid", "cell", "print", "count")
    return few.unionByName(block_links(large, most)).distinct()


def link_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = MOST) -> DataFrame:
    """``key``, fingerprint (16 hexadecimal digits) and component_id, the least ``key`` reachable over links of at most ``most`` differing bits.

    Documents of one fingerprint are one point, so copies cost one row each; null, empty and blank
    texts have fingerprint zero and link like others. Rows that share an id are documents of their
    own. A row of null id has its fingerprint and component like others, but names none: where
    all of a component are null, so is its id. Other columns aren't read.
    """
    rows = written(fingerprints(docs, text, key), "prints")
    points = written(rows.groupBy("print").agg(F.min(key).alias("least")), "points")
    links = written(close_pairs(points.select("print"), most), "links")
    labels = components(links).select(F.col("id").alias("print"), "label")
    labelled = points.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    point = written(labelled.select("print", "label").join(named, "label").select(F.col("print").alias("p"), "component_id"), "named")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(point, F.col("print") == F.col("p")).select(key, digits.alias("fingerprint"), "component_id")
