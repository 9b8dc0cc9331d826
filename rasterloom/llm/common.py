"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import written

__all__ = ["WHITE", "batches_of", "hash_sample", "mix64", "row_keyed", "table", "texts", "written"]

#: Bytes that separate words: space and 0x09 to 0x0D. ``bytes.split()`` splits on just these.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keyed(docs: DataFrame, key: str, *keep: str) -> DataFrame:
    """``key``, ``keep`` and ``row_id``, which is 0 but where rows share their key: these are numbered, so that both together tell rows apart.

    Only ids are grouped, and only rows of shared ids are written (their numbers must stay).
    """
    shared = docs.groupBy(F.col(key).alias("_shared_key")).count().filter(F.col("count") > 1).select("_shared_key")
    shared = written(shared, "shared-ids")
    own = docs.select(key, *keep)
    same = F.col(key).eqNullSafe(F.col("_shared_key"))
    numbered = own.join(shared, same, "left_semi").withColumn("row_id", F.monotonically_increasing_id() + 1)
    return own.join(shared, same, "left_anti").withColumn("row_id", F.lit(0).cast("long")).unionByName(written(numbered, "numbered"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.binary()).to_pylist()


def batches_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the first by hash order of ``key``, ties by ``key``.

    In a larger table a bound on the hash first leaves about twice as many, so what each
    partition sends to be merged shrinks as partitions become more. (Fewer than ``rows`` come if
    fewer hashes than half of those expected lie under the bound.)
    """
    h, n = F.xxhash64(key), df.count()
    if n > 2 * rows:
        df = df.filter(h < F.lit(-(2**63) + 2**65 * rows // n))
    return df.orderBy(h, key).limit(rows)
