"""Quantiles and ranks of groups of any size: values are counted by blocks in their order, so no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantiles(df: DataFrame, value: str, at: tuple[float, ...], by: tuple[str, ...], step: float = 0.001, cells: int = 4096) -> DataFrame:
    """``by`` and ``q``: interpolated quantiles per group of values rounded to multiples of ``step``.

    Values are counted, then cut into blocks of ``cells`` neighbouring steps. A window over a
    group sees one row a block, one over a block at most ``cells`` rows, so no task holds the
    values of a whole group. Nulls don't count; groups without a value are absent.
    """
    step_no = F.round(F.col(value) / step).cast("long")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, step_no.alias("_k")).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_k") / cells))
    upto = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_size"))
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_start"), F.sum("_size").over(W.partitionBy(*by)).alias("_whole"))
    inner = W.partitionBy(*by, "_block").orderBy("_k")
    own = counts.join(blocks, [*by, "_block"]).withColumn("_end", F.col("_start") + F.sum("_n").over(inner))
    own = own.withColumn("_first", F.col("_end") - F.col("_n"))
    low, high = [], []
    for q in at:
        place = q * (F.col("_whole") - 1)
        for out, spot in ((low, F.floor(place)), (high, F.ceil(place))):
            out.append(F.max(F.when((F.col("_first") <= spot) & (spot < F.col("_end")), F.col("_k"))))
    parts = own.groupBy(*by, "_whole").agg(F.array(*low).alias("_lo"), F.array(*high).alias("_hi"))
    share = [q * (F.col("_whole") - 1) - F.floor(q * (F.col("_whole") - 1)) for q in at]
    ends = [(F.col("_lo")[i] + f * (F.col("_hi")[i] - F.col("_lo")[i])) * step for i, f in enumerate(share)]
    return parts.select(*by, F.array(*ends).alias("q"))


def block_of(v: Column, bits: int = 8) -> Column:
    """The number of the block that a double falls into: 2^``bits`` blocks for each power of two, rising with the value.

    Blocks need no look at the data. Zero has one of its own, and so have both infinities; NaN
    comes last, as in Spark's order.
    """
    size = F.abs(v)
    power = F.least(F.floor(F.log2(size)), F.lit(1023))
    inside = F.floor((size / F.pow(F.lit(2.0), power.cast("double")) - 1) * (1 << bits))
    place = F.when(size == float("inf"), F.lit(1 << 40)).otherwise((power + 1100) * (1 << bits) + inside)
    return F.when(F.isnan(v), F.lit(1 << 41)).when(v == 0, F.lit(0)).when(v < 0, -place).otherwise(place).cast("long")


def _same(keys: list[str], left: str, right: str) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def exact_quantiles(df: DataFrame, value: str | Column, at: tuple[float, ...], by: tuple[str, ...]) -> DataFrame:
    """``by``, ``n`` and ``q``: the exact interpolated quantiles of a group's values, and how many there are.

    Rows are counted by block first, before they move; only rows of the blocks that hold a wanted
    place are then counted by value. A task sorts the distinct values of one block, not of a
    group. Nulls don't count; groups without a value are absent; null keys are a group.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    own = df.select(*by, v.alias("_v")).filter("_v is not null").withColumn("_block", block_of(F.col("_v")))
    over = W.partitionBy(*by)
    counts = own.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    ends = F.sum("_n").over(over.orderBy("_block").rowsBetween(W.unboundedPreceding, 0))
    placed = counts.select(*by, "_block", (ends - F.col("_n")).alias("_first"), ends.alias("_end"), F.sum("_n").over(over).alias("n"))
    place = [F.lit(float(q)) * (F.col("n") - 1) for q in at]
    spots = F.array_distinct(F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil))))
    wanted = placed.withColumn("_spots", F.filter(spots, lambda s: (s >= F.col("_first")) & (s < F.col("_end")))).filter(F.size("_spots") > 0).drop("_end")
    keys = [*by, "_block"]
    met = own.alias("a").join(wanted.alias("b"), _same(keys, "a", "b")).select(*(F.col(f"a.{k}").alias(k) for k in keys), "_v", "_first", "_spots", "n")
    inside = met.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("_first", "_spots", "n")))
    upto = F.col("_first") + F.sum("_n").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    hits = inside.withColumn("_to", upto).withColumn("_spot", F.explode(F.filter("_spots", lambda s: (s >= F.col("_to") - F.col("_n")) & (s < F.col("_to")))))
    found = hits.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_spot", "_v"))).alias("_m"))

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.col("_m")[low], F.col("_m")[high]
        # Two equal values give just that value, because rows may be compared with it.
        return F.when((low == high) | (a == b), a).otherwise((high - p) * a + (p - low) * b)

    return found.select(*by, "n", F.array(*(between(p) for p in place)).alias("q"))


def average_ranks(df: DataFrame, value: str, by: tuple[str, ...], name: str) -> DataFrame:
    """Adds ``name``, the average rank (from 1) of a value within its group, null for null; ties share the mean of their places.

    Distinct values are counted before they move and ranked inside their block; blocks start where
    those before them end. So windows hold a group's blocks, or a block's distinct values.
    """
    own = df.filter(F.col(value).isNotNull())
    counts = own.groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_block", block_of(F.col(value).cast("double")))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = own.groupBy(*by, block_of(F.col(value).cast("double")).alias("_block")).agg(F.count("*").alias("_size"))
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    keys = [*by, "_block"]
    inside = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(inside)).alias("a").join(blocks.alias("b"), _same(keys, "a", "b"))
    rank = F.col("_start") + F.col("_upto") - (F.col("_n") - 1) / 2
    ranked = ranked.select(*(F.col(f"a.{k}").alias(k) for k in by), value, rank.alias(name))
    return df.alias("a").join(ranked.alias("b"), _same([*by, value], "a", "b"), "left").select("a.*", name)
