"""Near-duplicate documents by a chosen-path set similarity join.

Every tree sends a document, level by level, to the child named by a minwise token of its set
under that level's hash function, so two documents with similarity J share a node with
probability J a level. Nodes that have become small are compared exhaustively (by sketch, then on
full sets); a node that is still large at the last level is compared in pairs of blocks. With
DEPTH 4 and TREES 20 a pair at J = 0.85 never meets with probability (1 - 0.85^4)^20 = 4e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, mix64, texts, written
from rasterloom.operators.graph import components

WORDS = 5
TREES, DEPTH = 20, 4
WIDTH = TREES * DEPTH
#: Nodes of at most so many documents are leaves; larger ones at the last level are cut into blocks.
LEAF, BLOCK = 32, 384
#: Of WIDTH sketch bytes, so many must agree before two sets are compared: 7.4 deviations under the mean at J = 0.85.
AGREE = 44

_P = np.uint64(0x9E3779B97F4A7C15) ** np.arange(WORDS, dtype=np.uint64)
_A = mix64(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_B = mix64(_A)


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of the whole sequence, if it is shorter; none without words."""
    own = data.lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, n)
    if n < words:
        return mix64(np.array([(h * _P[:n]).sum()], np.uint64) ^ np.uint64(n))
    total = h[: n - words + 1] * _P[0]
    for k in range(1, words):
        total = total + h[k : n - words + 1 + k] * _P[k]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """WIDTH minwise values (32 bits each) of a set that isn't empty."""
    least = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096][None, :] ^ _B[:, None]) * _A[:, None]
        np.minimum(least, part.min(1), out=least)
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


def _summaries(text: str, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            size, dig, sig = [], [], []
            for data in texts(batch.column(text)):
                own = shingle_hashes(data)
                size.append(len(own))
                dig.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sig.append(signature(own).view(np.int32) if len(own) else None)
            cols = [batch.column(keep), pa.array(size, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "signature"])

    return run


def summaries(docs: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, digest of the set and minwise signature of every whole text; digest and signature are null without words."""
    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, text).mapInArrow(_summaries(text, keep), f"doc_id {kind}, n_shingles long, digest binary, signature array<int>")


def grow_trees(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaf members, members of nodes that stay large): node, rep and signature bytes.

    ``classes``: rep, signature. A level counts its nodes before rows move, drops those of one
    document, passes small ones on as leaves and branches the rest by the next minwise token.
    """
    sig = F.col("signature")
    first = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda r: F.xxhash64(r, F.get(sig, r * DEPTH)))
    now = classes.select("rep", F.posexplode(first).alias("tree", "node"))
    leaves, large = [], None
    for level in range(DEPTH):
        sizes = now.groupBy(F.col("node").alias("n")).count().filter(F.col("count") > 1)
        sized = written(now.join(sizes, F.col("node") == F.col("n")).drop("n"), "nodes")
        leaves.append(sized.filter(F.col("count") <= LEAF).select("node", "rep"))
        large = sized.filter(F.col("count") > LEAF)
        if level + 1 < DEPTH:
            token = F.get(F.col("signature"), F.col("tree") * DEPTH + (level + 1))
            # A large node's rows bring back their signature by rep, which no key of theirs makes hot.
            now = large.drop("count").join(classes, "rep").select("rep", "tree", F.xxhash64("node", token).alias("node"))
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out, large.select("node", "rep", "count")


def _leaf_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a leaf whose sketches agree; rows come sorted by node, a node may span batches."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDTH), np.uint8))

    def pairs(node, rep, sketch) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(node)])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(size, 1)
            for at in range(0, (own := starts[sizes == size]).size, step := max(1, 100_000 // (size * size))):
                rows = own[at : at + step][:, None]
                a, b = (rows + i).ravel(), (rows + j).ravel()
                fine = (sketch[a] == sketch[b]).sum(1) >= AGREE
                left.append(np.minimum(rep[a[fine]], rep[b[fine]]))
                right.append(np.maximum(rep[a[fine]], rep[b[fine]]))
        found = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    held = empty
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, WIDTH)
        node = np.concatenate([held[0], batch.column(0).to_numpy(zero_copy_only=False)])
        rep = np.concatenate([held[1], batch.column(1).to_numpy(zero_copy_only=False)])
        sketch = np.concatenate([held[2], sketch])
        cut = int(np.searchsorted(node, node[-1]))
        yield pairs(node[:cut], rep[:cut], sketch[:cut])
        held = node[cut:], rep[cut:], sketch[cut:]
    yield pairs(*held)


def sketch_of(signature: Column) -> Column:
    """One byte of each minwise value."""
    return F.unhex(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), ""))


def _sets(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            own = [shingle_hashes(x).tobytes() for x in texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(own, pa.binary())], ["rep", "shingles"])

    return run


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 1024):
        fine = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            fine.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _similar(it, percent), "a long, b long")


def spanning_links(reps: np.ndarray, sets: list[np.ndarray], percent: int, chunk: int = 8192) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs that reach the similarity; exact, by counts of shared shingles."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = counts > 1
    col = (np.cumsum(shared) - 1)[inverse]
    row, col = row[shared[inverse]], col[shared[inverse]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(shared.sum()), chunk):
        low, high = np.searchsorted(col, [at, at + chunk])
        part = np.zeros((n, chunk), np.float32)
        part[row[low:high], col[low:high] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    links = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.full(n, -1)
    out = []
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root], edge = root, [root]
        while edge:
            x = edge.pop()
            for y in np.flatnonzero(links[x] & (label < 0)):
                label[y] = root
                out.append((int(min(reps[x], reps[y])), int(max(reps[x], reps[y]))))
                edge.append(int(y))
    return out


def large_node_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within nodes that stayed large. Blocks of about BLOCK members meet in pairs; a task holds two blocks."""
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("node", "rep", "own", other).select(
        "node", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep")
        found = spanning_links(pdf["rep"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["shingles"]], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.join(sets, "rep").groupBy("node", "i", "j").applyInPandas(meet, "a long, b long")


def link_documents(docs: DataFrame, text: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per document.

    Documents are linked if 100 x shared shingles >= percent x all shingles of both; component_id
    is the smallest doc_id reachable and ``kept`` marks it. Documents of the same set are one
    class, which its smallest doc_id stands for, so copies cost one row each. Texts that are null
    or without words have no shingle and are linked with nothing. A null doc_id has a null
    component_id and stays. Rows that share a doc_id are one document to others, and all of them
    are ``kept`` or none. Ids must be integers; other columns aren't read.
    """
    rows = written(summaries(docs.withColumn("doc_id", F.col("doc_id").cast("long")), text), "summaries")
    classes = (
        rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    )
    classes = written(classes, "classes")
    leaves, large = grow_trees(classes.select("rep", "signature"))
    sketches = classes.select("rep", sketch_of(F.col("signature")).alias("sketch"))
    pairs = (
        leaves.join(sketches, "rep")
        .select("node", "rep", "sketch")
        .repartition("node")
        .sortWithinPartitions("node")
        .mapInArrow(_leaf_pairs, "a long, b long")
        .distinct()
    )
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(large.select("rep")).distinct()
    # A doc_id with several rows takes the text of the class it stands for.
    # ``asked`` grows with the documents, so it isn't broadcast, however small it is here.
    bodies = docs.select(F.col("doc_id").cast("long").alias("rep"), text).join(asked.hint("merge"), "rep")
    sets = written(bodies.mapInArrow(_sets(text), "rep long, shingles binary").dropDuplicates(["rep"]), "sets")
    links = confirm(pairs, sets, percent).union(large_node_links(large, sets, percent))
    labels = components(links)
    named = classes.select(F.col("digest").alias("d"), "rep").join(labels, F.col("rep") == F.col("id"), "left")
    named = named.select("d", F.coalesce("label", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows.join(named, F.col("digest") == F.col("d"), "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, text: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` without the documents that ``link_documents`` doesn't keep."""
    gone = link_documents(docs, text, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct().alias("gone")
    return docs.alias("own").join(gone, F.col("own.doc_id") == F.col("gone.gone_id"), "left_anti")
