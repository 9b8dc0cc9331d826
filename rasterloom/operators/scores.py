"""Surface-quality metrics over pixel tables: errors, correlation, calibration and summaries, by any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators import ranks


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def error_columns(pred: str | Column = "pred", ref: str | Column = "ref") -> dict[str, Column]:
    """n_px, mae_m, rmse_m, bias_m and std_m (population) over rows where both values are there."""
    e = _col(pred) - _col(ref)
    return {
        "n_px": F.count(e),
        "mae_m": F.avg(F.abs(e)),
        "rmse_m": F.sqrt(F.avg(e * e)),
        "bias_m": F.avg(e),
        "std_m": F.stddev_pop(e),
    }


def with_middles(errors: DataFrame, px: DataFrame, pred: str | Column, ref: str | Column, by: tuple[str, ...]) -> DataFrame:
    """``errors`` (a row a group) with median_ae_m and p90_ae_m, the quantiles of the group's absolute errors."""
    q = ranks.exact_quantiles(px, F.abs(_col(pred) - _col(ref)), (0.5, 0.9), by)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    return errors.alias("a").join(q.alias("b"), on, "left").select("a.*", F.col("q")[0].alias("median_ae_m"), F.col("q")[1].alias("p90_ae_m"))


def evaluate(px: DataFrame, pred: str = "pred", ref: str = "ref", by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """One row of errors per group; a group without a joint value has n_px 0 and nulls."""
    errors = px.groupBy(*by).agg(*(c.alias(k) for k, c in error_columns(pred, ref).items()))
    return with_middles(errors, px, pred, ref, by)


def delta1(px: DataFrame, pred: str, ref: str, by: tuple[str, ...] = ("scene_id",), least: float = 0.5) -> DataFrame:
    """Share of pixels whose height ratio (the larger over the smaller) is under 1.25, where both heights exceed ``least``."""
    a, b = F.col(pred), F.col(ref)
    fine = (a > least) & (b > least)
    ratio = F.greatest(F.try_divide(a, b), F.try_divide(b, a))
    return px.groupBy(*by).agg(F.avg(F.when(fine, (ratio < 1.25).cast("double"))).alias("delta1"), F.count_if(fine).alias("delta1_n_px"))


def coverage(px: DataFrame, err: str, sigma: str, by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Shares of errors within one and two sigma, and the mean sigma."""
    e, s = F.abs(F.col(err)), F.col(sigma)
    return px.groupBy(*by).agg(
        F.avg((e <= s).cast("double")).alias("coverage_1s"), F.avg((e <= 2 * s).cast("double")).alias("coverage_2s"), F.avg(s).alias("mean_sigma_m")
    )


def correlations(px: DataFrame, pred: str = "pred", ref: str = "ref", by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Pearson and Spearman correlation; null under three joint values or for a constant side."""
    both = px.filter(F.col(pred).isNotNull() & F.col(ref).isNotNull()).select(*by, pred, ref)
    ranked = ranks.average_ranks(ranks.average_ranks(both, pred, by, "_p"), ref, by, "_r")
    fine = (F.count("*") >= 3) & (F.max(pred) > F.min(pred)) & (F.max(ref) > F.min(ref))
    return ranked.groupBy(*by).agg(F.when(fine, F.corr(pred, ref)).alias("pearson_r"), F.when(fine, F.corr("_p", "_r")).alias("spearman_r"))


def calibration_error(px: DataFrame, err: str, sigma: str, by: tuple[str, ...] = ("scene_id",), bins: int = 10) -> DataFrame:
    """Expected calibration error: over bins of equal count by sigma, the mean gap between RMS error and mean sigma.

    Bins of under 10 rows don't count; a group of under 10 rows a bin has null. The bin edges are
    exact quantiles, half-open, the last widened by 1e-9.
    """
    own = px.filter(F.col(err).isNotNull() & (F.col(sigma) > 0)).select(*by, F.col(err).alias("e"), F.col(sigma).alias("s"))
    edges = ranks.exact_quantiles(own, "s", tuple(k / bins for k in range(bins + 1)), by).withColumnRenamed("n", "n_all")
    # The bin is the number of inner edges at or under sigma; equal edges make empty bins, as half-open ones are.
    inner = F.slice("q", 2, bins - 1)
    binned = own.join(edges, list(by)).withColumn("bin", F.size(F.filter(inner, lambda x: x <= F.col("s"))))
    rows = binned.groupBy(*by, "n_all", "bin").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), F.avg("s").alias("mean"))
    fine = F.when(F.col("n") >= 10, F.col("n"))
    gap = F.sum(fine * F.abs(F.col("rms") - F.col("mean"))) / F.sum(fine)
    return rows.groupBy(*by).agg(F.when(F.first("n_all") >= 10 * bins, gap).alias("ece_m"), F.count(fine).alias("n_bins"))


def evaluate_by_class(px: DataFrame, pred: str = "pred", ref: str = "ref", cls: str = "sem", err: str = "err", sigma: str = "sigma", least: int = 50) -> DataFrame:
    """Errors and coverage of each scene overall (class null) and per class; classes of under ``least`` pixels are left out."""
    e, s = F.abs(F.col(err)), F.col(sigma)
    more = {"coverage_1s": F.avg((e <= s).cast("double")), "coverage_2s": F.avg((e <= 2 * s).cast("double")), "mean_sigma_m": F.avg(s)}
    sets = px.groupingSets([["scene_id"], ["scene_id", cls]], "scene_id", cls)
    out = sets.agg(F.grouping(cls).alias("overall"), *(c.alias(k) for k, c in (error_columns(pred, ref) | more).items()))
    out = out.filter((F.col("overall") == 1) | (F.col(cls).isNotNull() & (F.col("n_px") >= least)))
    # A pixel counts for its scene, where the class is null, and for its class; grouping() keeps both apart.
    kind = px.schema[cls].dataType
    each = F.array(F.struct(F.lit(1).cast("tinyint").alias("overall"), F.lit(None).cast(kind).alias(cls)), F.struct(F.lit(0).cast("tinyint").alias("overall"), F.col(cls).alias(cls)))
    both = px.select("scene_id", _col(pred).alias("_pred"), _col(ref).alias("_ref"), F.explode(each).alias("_k")).select("scene_id", "_k.*", "_pred", "_ref")
    return with_middles(out, both, "_pred", "_ref", ("scene_id", "overall", cls))


def aggregate_study(records: DataFrame, metrics: list[str], key: str = "scene_id") -> DataFrame:
    """metric, n, mean, std (population), min and max over scenes, of finite values only."""
    long = records.unpivot([key], metrics, "metric", "value").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return long.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def relief_report(px: DataFrame, pred: str, true: str, by: tuple[str, ...] = ("scene_id",), least: float = 2.0) -> DataFrame:
    """Share of pixels that stand above ``least`` in truth, and mean and max heights of both."""
    return px.groupBy(*by).agg(
        F.avg((F.col(true) > least).cast("double")).alias("object_fraction"),
        F.avg(true).alias("true_mean_m"), F.max(true).alias("true_max_m"), F.avg(pred).alias("pred_mean_m"), F.max(pred).alias("pred_max_m"),
    )


def class_fractions(px: DataFrame, cls: str = "sem", by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Share of each class among a group's pixels; the window sees one row per class."""
    counts = px.groupBy(*by, cls).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def finite_stats(px: DataFrame, layers: list[str], by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Per group and layer: min, max, mean and the 1st, 95th and 99th percentile of non-null values."""
    long = px.unpivot(list(by), layers, "layer", "v").filter(F.col("v").isNotNull())
    q = ranks.exact_quantiles(long, "v", (0.01, 0.95, 0.99), (*by, "layer")).drop("n")
    out = long.groupBy(*by, "layer").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean")).join(q, [*by, "layer"])
    return out.select(*by, "layer", "least", "most", "mean", F.col("q")[0].alias("p1"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def otsu(px: DataFrame, value: str, by: tuple[str, ...] = ("scene_id",), bins: int = 256) -> DataFrame:
    """The threshold (a bin's centre) that parts a histogram of ``bins`` equal bins with the largest variance between both sides; the first of equals."""
    own = px.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    span = own.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    hist = own.join(span, list(by)).groupBy(*by, "lo", "hi", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    centre = F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bin") + 0.5) * width).otherwise(F.col("lo") - 0.5 + (F.col("bin") + 0.5) / bins)
    upto, whole = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
    sums = hist.withColumn("c", centre).select(
        *by, "bin", "c",
        F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("c")).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("n_all"), F.sum(F.col("n") * F.col("c")).over(whole).alias("s_all"),
    )
    n1 = F.col("n_all") - F.col("n0")
    gap = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s_all") - F.col("s0"), n1)
    between = F.coalesce(F.col("n0") * n1 * gap * gap, F.lit(0.0))
    best = F.max_by(F.struct("bin", "c"), F.struct(F.round(between, 6), -F.col("bin")))
    return sums.groupBy(*by).agg(best.alias("best")).select(*by, F.col("best.bin").alias("bin"), F.col("best.c").alias("threshold"))


def scene_target(px: DataFrame, pos: str, ndsm: str, by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """The scale that brings ``pos`` closest to true heights: sum of products over sum of squares; null if the latter isn't positive."""
    p, t = F.col(pos), F.col(ndsm)
    bottom = F.sum(F.when(t.isNotNull(), p * p))
    return px.groupBy(*by).agg(F.when(bottom > 0, F.sum(p * t) / bottom).alias("target"), F.count(p * t).alias("n_px"))


def model_sigma(surfaces: DataFrame, value: str = "z", by: tuple[str, ...] = ("scene_id", "row", "col")) -> DataFrame:
    """Spread of several surfaces: 0 for one, half the difference for two (their population deviation), the population deviation for more."""
    return surfaces.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("sigma_model"))


def mask_quality(mask: DataFrame, px: DataFrame, height: str, least: float = 2.5) -> DataFrame:
    """Per scene: share of pixels under any mask, and recall and precision against pixels above ``least``."""
    covered = mask.select("scene_id", "row", "col").distinct().withColumn("covered", F.lit(1))
    both = px.join(covered, ["scene_id", "row", "col"], "left")
    tall, on = F.col(height) > least, F.col("covered").isNotNull()
    return both.groupBy("scene_id").agg(
        F.avg(on.cast("double")).alias("coverage"),
        F.try_divide(F.count_if(on & tall), F.count_if(tall)).alias("recall"),
        F.try_divide(F.count_if(on & tall), F.count_if(on)).alias("precision"),
    )


def metrics_table(records: DataFrame, order: tuple[str, ...], digits: int = 3) -> DataFrame:
    """place, metric and mean, least and most over scenes as text of fixed digits; metrics in the given order, those not named are left out."""
    long = records.unpivot([], list(order), "metric", "v").groupBy("metric").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    shown = lambda c: F.format_string(f"%.{digits}f", F.col(c)).alias(c)
    place = F.array_position(F.array(*(F.lit(m) for m in order)), F.col("metric")).cast("int")
    return long.select(place.alias("place"), "metric", shown("mean"), shown("least"), shown("most"))
