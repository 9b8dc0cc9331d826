"""Approximate nearest neighbours by additive quantisation.

Vectors are sums of one entry from each of several full-dimensional codebooks. Encoding is a beam
search over residuals; codes and the norms of the sums are stored. Queries score codes by lookup
tables, where norms end a scan early, and one shortlist a query is reranked on the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, hash_sample, written


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


@dataclass
class Codebooks:
    """``books``: codebooks x entries x dimensions, with the inner products of all entries."""

    books: np.ndarray

    def __post_init__(self) -> None:
        self.m, self.k, self.d = self.books.shape
        self.flat = self.books.reshape(-1, self.d).astype(np.float32)
        self.cross = self.flat @ self.flat.T
        self.norms = np.diag(self.cross).copy()

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """Codes (rows x codebooks) by beam search: each step keeps the ``beam`` partial sums nearest to the vector."""
        n = len(x)
        inner = x.astype(np.float32) @ self.flat.T
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)
        for j in range(self.m):
            own = slice(j * self.k, (j + 1) * self.k)
            # |x - s - c|^2 = |x - s|^2 + |c|^2 - 2 x.c + 2 s.c, where s.c sums inner products of entries.
            step = (self.norms[own] - 2 * inner[:, own])[:, None, :] + cost[:, :, None]
            for i in range(j):
                step = step + 2 * self.cross[codes[:, :, i] + i * self.k, own]
            wide = step.reshape(n, -1)
            width = min(beam, wide.shape[1])
            pick = np.argpartition(wide, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(wide, pick, 1)
            parent, entry = pick // self.k, pick % self.k
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), entry[:, :, None]], 2)
        best = cost.argmin(1)
        return codes[np.arange(n), best].astype(np.uint8 if self.k <= 256 else np.uint16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j][codes[:, j]] for j in range(self.m))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def train_codebooks(sample: np.ndarray, m: int = 16, k: int = 128, rounds: int = 1, seed: int = 7) -> Codebooks:
    """Residual k-means, then rounds of beam encoding and joint least squares over all entries."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    left, books = x.copy(), []
    for _ in range(m):
        c = _kmeans(left, k, rng)
        left = left - c[(np.square(c).sum(1) - 2 * left @ c.T).argmin(1)]
        books.append(c)
    out = Codebooks(np.stack(books))
    for _ in range(rounds):
        codes = np.concatenate([out.encode(x[a : a + 1024]) for a in range(0, len(x), 1024)]).astype(np.int64) + np.arange(m) * k
        gram = np.zeros((m * k, m * k))
        for i in range(m):
            for j in range(m):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1.0)
        rhs = np.zeros((m * k, x.shape[1]))
        for i in range(m):
            np.add.at(rhs, codes[:, i], x)
        # The ridge holds entries that few rows use near where they were.
        solved = np.linalg.solve(gram + 0.5 * np.eye(m * k), rhs + 0.5 * out.flat)
        out = Codebooks(solved.reshape(m, k, -1).astype(np.float32))
    return out


def vectors_of(df: DataFrame, key: str, vec: str, size: int | None = None) -> tuple[DataFrame, int | None]:
    """(vec_id, digest, vector; the dimension): usable vectors of ids that aren't null, one row an id, as arrays of doubles.

    The dimension is ``size`` or, if that isn't given, the one that most rows have (ties: the
    least); vectors of others take no part. Of rows that share an id, the one of least digest
    counts, whatever their order.
    """
    rows = df.filter(F.col(key).isNotNull() & usable(F.col(vec))).select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vector"))
    if size is None:
        top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if top is None:
            return rows, None
        size = top["d"]
    rows = rows.filter(F.size("vector") == size).select("vec_id", F.md5(F.to_json(F.struct("vector"))).alias("digest"), "vector")
    return rows.groupBy("vec_id").agg(F.min(F.struct("digest", "vector")).alias("v")).select("vec_id", "v.*"), size


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """rep, vector and ``members``, the ``most`` smallest ids of each distinct vector; ``rep`` is the least.

    Only so many ids of equal vectors can be among as many nearest; the others go before they
    move, so copies of a vector are no large group.
    """
    nth = F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))
    few = rows.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    out = few.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("members"), F.first("vector").alias("vector"))
    return out.select(F.col("members")[0].alias("rep"), "members", "vector")


def fit(classes: DataFrame, rows: int = 8192, **settings) -> Codebooks | None:
    """Codebooks from at most ``rows`` distinct vectors, taken in hash order of their ids; None without any."""
    sample = hash_sample(classes.select("rep", "vector"), "rep", rows).toPandas()
    return None if sample.empty else train_codebooks(np.stack(sample["vector"].to_numpy()).astype(np.float64), **settings)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(classes: DataFrame, books: Codebooks, beam: int = 8) -> DataFrame:
    """rep, codes (bytes) and ``norm`` of the coded sum."""
    model = classes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches_of(batches, 512):
            if batch.num_rows:
                codes = own.encode(matrix(batch.column(1)), beam)
                norm = np.linalg.norm(own.decode(codes), axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norm)], ["rep", "codes", "norm"])

    return classes.select("rep", "vector").mapInArrow(run, "rep long, codes binary, norm double")


def best_codes(books: Codebooks, shortlist: int, ids: np.ndarray, codes: list[bytes], norms: np.ndarray, q: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the ``shortlist`` codes of largest table score for each query.

    Codes go by falling norm. No score exceeds the norms' product, so the scan ends where that
    can't reach the least score that any query has kept.
    """
    order = np.lexsort((ids, -norms))
    ids, norms = ids[order], norms[order]
    code = np.frombuffer(b"".join(codes), np.uint8 if books.k <= 256 else np.uint16).reshape(len(ids), -1)[order]
    table = (q.astype(np.float32) @ books.flat.T).reshape(len(q), books.m, books.k)
    length = np.linalg.norm(q, axis=1)
    score, place = np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0), np.int64)
    for at in range(0, len(ids), step):
        # Scores are sums of single precision, so the bound is taken a little wider.
        if score.shape[1] >= shortlist and (length * norms[at] * 1.001 + 1e-6 < score.min(1)).all():
            break
        part = code[at : at + step]
        own = np.zeros((len(q), len(part)), np.float32)
        for j in range(books.m):
            own += table[:, j, :][:, part[:, j]]
        score = np.concatenate([score, own], 1)
        place = np.concatenate([place, np.broadcast_to(np.arange(at, at + len(part)), own.shape)], 1)
        if score.shape[1] > shortlist:
            pick = np.argpartition(-score, shortlist - 1, axis=1)[:, :shortlist]
            score, place = np.take_along_axis(score, pick, 1), np.take_along_axis(place, pick, 1)
    return np.repeat(np.arange(len(q)), score.shape[1]), ids[place.ravel()], score.ravel().astype(np.float64)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vec: str = "embedding",
    shortlist: int = 1024,
    block: int = 1 << 17,
    query_block: int = 1024,
    rows: int = 8192,
    **settings,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` of largest inner product found for each query.

    Every distinct usable vector is coded, and its codes (not the vector) meet every query in
    blocks of about ``block`` codes by ``query_block`` queries that hash order deals out. The
    ``shortlist`` best of all blocks (at least k + 1) are scored on the vectors, which move once
    for the vectors and once for each entry of a shortlist. ``rows`` bounds the sample that
    codebooks are fitted on.

    A row is no candidate for a query of its own id; ties go to the smaller id. Vectors that
    ``usable`` refuses or of another dimension than most have, and null ids, take no part on either
    side; of rows that share an id one counts (``vectors_of``). Without vectors or queries there
    are no rows; with fewer candidates than ``k``, all of them come.
    """
    spark = vectors.sparkSession
    shortlist = max(shortlist, k + 1)
    plain, size = vectors_of(vectors, key, vec)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return nothing
    classes = written(classes_of(plain, k + 1), "vectors")
    books = fit(classes, rows, **settings)
    coded = written(index(classes, books), "codes")
    asked = written(vectors_of(queries, key, vec, size)[0].select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector")), "queries")
    n, m = coded.count(), asked.count()
    n_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    model = spark.sparkContext.broadcast(books)

    left = coded.select("rep", "codes", "norm", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    right = asked.select(
        "query_id", "q_vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q")
    )

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "rep": [], "near": []})]
        if len(mine):
            ids, codes, norms = mine["rep"].to_numpy(), mine["codes"].tolist(), mine["norm"].to_numpy()
            for at in range(0, len(theirs), 256):
                some = theirs.iloc[at : at + 256]
                which, rep, near = best_codes(model.value, shortlist, ids, codes, norms, np.stack(some["q_vector"].to_numpy()))
                out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[which], "rep": rep, "near": near}))
        return pd.concat(out) if len(out) == 1 else pd.concat(out[1:])

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(meet, "query_id long, rep long, near double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "rep"))
    short = written(found.withColumn("_nth", nth).filter(F.col("_nth") <= shortlist).select("query_id", "rep"), "shortlists")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                exact = np.einsum("ij,ij->i", matrix(batch.column(2)), matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact), batch.column(4)], ["query_id", "rep", "score", "members"])

    # Both sides grow with the table, so neither is broadcast.
    met = short.join(classes.hint("merge"), "rep").join(asked.hint("merge"), "query_id").select("query_id", "rep", "q_vector", "vector", "members")
    exact = met.mapInArrow(products, "query_id long, rep long, score double, members array<long>")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rep"))
    some = exact.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).select("query_id", "score", F.explode("members").alias("vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = some.filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
