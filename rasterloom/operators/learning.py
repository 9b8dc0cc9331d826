"""Choice of a scale model by leaving one scene out, and bootstrap spreads of robust fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.joins import global_affine


def leave_one_out(samples: DataFrame, px: DataFrame) -> DataFrame:
    """name, kind (constant or linear), the scale predicted without the scene, and its held-out mean absolute error.

    ``samples``: name, target, x (1 over the feature); ``px``: name, pos, truth. What the other
    scenes say comes from totals minus the scene's own part, so scenes are never paired up.
    """
    s = samples.filter(F.col("target").isNotNull())
    x, y = F.col("x"), F.col("target")
    total = s.agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy")).first()
    n = F.lit(total["n"]) - 1
    sx, sy, sxx, sxy = (F.lit(float(total[k] or 0)) - own for k, own in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y)))
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    linear = slope * x + (sy - slope * sx) / n
    models = F.array(
        F.struct(F.lit("constant").alias("kind"), F.when(n > 0, sy / n).alias("a")), F.struct(F.lit("linear").alias("kind"), F.when(n >= 3, linear).alias("a"))
    )
    held = s.select("name", F.explode(models).alias("m")).select("name", "m.kind", "m.a")
    off = F.abs(F.greatest(F.col("a") * F.col("pos"), F.lit(0.0)) - F.col("truth"))
    return px.join(held, "name").groupBy("name", "kind", "a").agg(F.avg(off).alias("mae_m"))


def fit_scale(samples: DataFrame, px: DataFrame) -> DataFrame:
    """One row: the kind that wins by mean held-out error (linear only with over three scenes), both errors, and the constant."""
    n = samples.filter(F.col("target").isNotNull()).agg(F.count("*").alias("n_scenes"), F.avg("target").alias("value"))
    held = leave_one_out(samples, px).groupBy("kind").agg(F.avg("mae_m").alias("mae")).groupBy().pivot("kind", ["constant", "linear"]).agg(F.first("mae"))
    both = n.withColumn("one", F.lit(1)).join(held.withColumn("one", F.lit(1)), "one").drop("one")
    wins = (F.col("n_scenes") > 3) & (F.col("linear") < F.col("constant"))
    return both.select("n_scenes", "value", F.col("constant").alias("loo_constant"), F.col("linear").alias("loo_linear"), F.when(wins, "linear").otherwise("constant").alias("kind"))


def bootstrap_affine(anchors: DataFrame, replicates: int = 24, share: int = 70, seed: str = "boot", few: int = 8) -> DataFrame:
    """scene_id, n, mean and sample deviation of slope and offset over fits to subsets of ``share`` percent of the anchors.

    An anchor is in a replicate if the number drawn from both ids says so, so replicates are
    independent of the order of rows and need no ranking; all are fitted in one set of
    aggregations keyed by scene and replicate. Scenes of under ``few`` anchors have deviation 0.
    A subset of one anchor has slope 1 and that anchor's own offset, so that it doesn't pull the mean to 0.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate"), F.col("anchor_id")).cast("binary")), 1, 8), 16, 10).cast("long") % 100
    spread = anchors.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).filter(drawn < share)
    fits = global_affine(spread, by=("scene_id", "replicate"), lone_zero=False)
    count = anchors.groupBy("scene_id").agg(F.count("*").alias("n_anchors"))
    out = fits.groupBy("scene_id").agg(*(f(c).alias(f"{c}_{k}") for c in ("a", "b") for k, f in (("mean", F.avg), ("std", F.stddev_samp))))
    is_few = F.col("n_anchors") < few
    return out.join(count, "scene_id").select(
        "scene_id", "n_anchors", "a_mean", F.when(is_few, 0.0).otherwise(F.col("a_std")).alias("a_std"), "b_mean", F.when(is_few, 0.0).otherwise(F.col("b_std")).alias("b_std")
    )
