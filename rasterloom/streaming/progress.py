"""Run progress and scores, over finished tables or over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds that a phase takes, as weights of the whole.
PHASE_SECONDS = {
    "ingest": 0.26, "instances": 48.6, "depth": 151.55, "segmentation": 0.57, "shadow": 0.21, "anchors": 0.44, "calibration": 1.46,
    "uncertainty": 3.03, "assemble": 0.64, "artifacts": 4.50, "validation": 5.76, "tiles": 20.83, "refine": 450.0,
}


def latest_states(events: DataFrame) -> DataFrame:
    """The last state (status, pct) of each job and phase; works on streams too, with one row of state for each."""
    last = F.max_by(F.struct("status", "pct"), F.struct("ts", "event_id"))
    return events.groupBy("job", "phase").agg(last.alias("s")).select("job", "phase", "s.status", "s.pct")


def run_progress(states: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """job and ``progress`` from 0 to 1 over the phases that aren't skipped: done counts whole, running by its share; an unknown phase weighs 1."""
    table = weights or PHASE_SECONDS
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    live = F.col("status") != "skipped"
    w = F.when(live, F.coalesce(F.try_element_at(known, F.col("phase")), F.lit(1.0))).otherwise(0.0)
    got = F.when(F.col("status") == "done", 1.0).when(F.col("status") == "running", F.col("pct")).otherwise(0.0)
    share = F.coalesce(F.try_divide(F.sum(w * got), F.sum(w)), F.lit(0.0))
    return states.groupBy("job").agg(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("progress"), F.count_if(live).alias("n_phases"))


def running_scores(px: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Per scene n and the sums of the error, its absolute value and its square; sums add up over batches, so any metric of them does."""
    e = F.col(pred) - F.col(ref)
    return px.groupBy("scene_id").agg(F.count(e).alias("n_px"), F.sum(F.abs(e)).alias("abs_sum"), F.sum(e * e).alias("sq_sum"), F.sum(e).alias("sum"))


def scores_of(sums: DataFrame) -> DataFrame:
    return sums.select("scene_id", "n_px", (F.col("abs_sum") / F.col("n_px")).alias("mae_m"), F.sqrt(F.col("sq_sum") / F.col("n_px")).alias("rmse_m"), (F.col("sum") / F.col("n_px")).alias("bias_m"))


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that its source holds now and returns its result table."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)
