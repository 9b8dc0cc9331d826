"""Multi-party perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _header(out_role: Column, name: Column) -> Column:
    named = F.concat(F.lit(" name="), name)
    return F.concat(F.lit(OPEN), out_role, F.coalesce(named, F.lit("")), F.lit("\n"))


def rotate_perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    narrator: str = "system",
    stretch: int = 64,
) -> DataFrame:
    """Renders every dialogue once for each participant, who becomes the assistant.

    Result: one row for each dialogue, perspective and message, with the message as it stands in
    that rendering (``rendered``), its place ``[start, end)`` in code points, and the part that
    bears loss, ``[mask_start, mask_end)`` (null for messages of the others). Joining ``rendered``
    by ``seq`` gives the whole rendering. Keeping messages apart bounds the rows of a task: a
    dialogue of any length is dealt out by stretches of ``stretch`` turns, and places come from
    sums over stretches.

    - The other speakers are users with their name; the narrator's turns are system messages,
      and the narrator has no perspective of its own.
    - A null text is empty, a null speaker is ``unknown``. A null dialogue id is an id of its
      own. A dialogue of only narrator turns has no perspective and gives no row.
    - Turns go by ``turn`` (null last), ties by speaker and text; equal rows all stay.
    - Only the four named columns are read, so other columns can't clash.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / stretch), F.lit(2**62)).cast("long"))
    seats = (
        rows.filter(F.col("role") != narrator)
        .select(F.col("conv_id").alias("seat_conv"), F.col("role").alias("perspective"))
        .distinct()
    )
    out_role = (
        F.when(F.col("role") == narrator, F.lit("system"))
        .when(F.col("role") == F.col("perspective"), F.lit("assistant"))
        .otherwise(F.lit("user"))
    )
    seen = (
        rows.join(seats, F.col("conv_id").eqNullSafe(F.col("seat_conv")))
        .drop("seat_conv")
        .withColumn("out_role", out_role)
        .withColumn("name", F.when(F.col("out_role") == "user", F.col("role")))
        .withColumn("header", _header(F.col("out_role"), F.col("name")))
        .withColumn("rendered", F.concat("header", "text", F.lit(CLOSE)))
        .withColumn("size", F.length("rendered").cast("long"))
    )
    # Places before a stretch: a sum over stretches, not over turns.
    sums = seen.groupBy("conv_id", "perspective", "part").agg(
        F.sum("size").alias("part_size"), F.count("*").alias("part_rows")
    )
    before = W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        F.col("conv_id").alias("c"),
        F.col("perspective").alias("p"),
        F.col("part").alias("k"),
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
    )
    inside = W.partitionBy("conv_id", "perspective", "part").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    placed = seen.withColumn("upto", F.sum("size").over(upto)).withColumn("nth", F.row_number().over(inside))
    joined = placed.join(
        starts,
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("k")),
    )
    end = F.col("size_before") + F.col("upto")
    start = end - F.col("size")
    mine = F.col("out_role") == "assistant"
    return joined.select(
        "conv_id",
        "perspective",
        (F.col("rows_before") + F.col("nth") - 1).cast("long").alias("seq"),
        "turn",
        "out_role",
        "name",
        "rendered",
        start.cast("long").alias("start"),
        end.cast("long").alias("end"),
        F.when(mine, start + F.length("header")).cast("long").alias("mask_start"),
        F.when(mine, end - F.lit(1)).cast("long").alias("mask_end"),
    )


ROTATE_SQL = f"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM conversations
), seats AS (
  SELECT DISTINCT conv_id AS seat_conv, role AS perspective FROM rows WHERE role <> 'system'
), seen AS (
  SELECT r.*, s.perspective,
         CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS out_role
  FROM rows r JOIN seats s ON r.conv_id IS NOT DISTINCT FROM s.seat_conv
), named AS (
  SELECT *, CASE WHEN out_role = 'user' THEN role END AS name,
         '{OPEN}' || out_role || coalesce(' name=' || CASE WHEN out_role = 'user' THEN role END, '') || chr(10) AS header
  FROM seen
), sized AS (
  SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered FROM named
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq,
         sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM sized
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, out_role, name, rendered,
       CAST(stop - length(rendered) AS BIGINT) AS "start", CAST(stop AS BIGINT) AS "end",
       CAST(CASE WHEN out_role = 'assistant' THEN stop - length(rendered) + length(header) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN out_role = 'assistant' THEN stop - 1 END AS BIGINT) AS mask_end
FROM placed
"""
