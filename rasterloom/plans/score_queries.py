"""Queries of surface-quality metrics on the pixel view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import scores
from rasterloom.plans.registry import Registry, rounded
from rasterloom.sources import views

registry = Registry()

#: px in metres with its error; heights are taken above 20 m.
M_SQL = f"""WITH {views.PX_SQL}, m AS (
  SELECT *, ref_mm / 1000.0 AS ref, pred_mm / 1000.0 AS pred, sigma_mm / 1000.0 AS sigma,
         (pred_mm - ref_mm) / 1000.0 AS err, (ref_mm % 30000) / 1000.0 AS h_ref, (pred_mm % 30000) / 1000.0 AS h_pred
  FROM px
)
"""
ERRORS_SQL = """count(pred - ref) AS n_px, round(avg(abs(pred - ref)), 6) AS mae_m, round(sqrt(avg((pred - ref) * (pred - ref))), 6) AS rmse_m,
  round(avg(pred - ref), 6) + 0::DOUBLE AS bias_m, round(quantile_cont(abs(pred - ref), 0.5), 6) AS median_ae_m,
  round(quantile_cont(abs(pred - ref), 0.9), 6) AS p90_ae_m, round(stddev_pop(pred - ref), 6) AS std_m"""
COVERAGE_SQL = """round(avg(CAST(abs(err) <= sigma AS INTEGER)), 6) AS coverage_1s,
  round(avg(CAST(abs(err) <= 2 * sigma AS INTEGER)), 6) AS coverage_2s, round(avg(sigma), 6) AS mean_sigma_m"""


def metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.px(spark, sf_dir)
    return px.withColumns(
        {
            "ref": F.col("ref_mm") / 1000.0,
            "pred": F.col("pred_mm") / 1000.0,
            "sigma": F.col("sigma_mm") / 1000.0,
            "err": (F.col("pred_mm") - F.col("ref_mm")) / 1000.0,
            "h_ref": F.col("ref_mm") % 30_000 / 1000.0,
            "h_pred": F.col("pred_mm") % 30_000 / 1000.0,
        }
    )


@registry.add(M_SQL + f"SELECT scene_id, {ERRORS_SQL} FROM m GROUP BY scene_id")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.evaluate(metres(spark, sf_dir)))


@registry.add(
    M_SQL
    + """, ranked AS (
  SELECT scene_id, pred, ref, rank() OVER (PARTITION BY scene_id ORDER BY pred) + (count(*) OVER (PARTITION BY scene_id, pred) - 1) / 2.0 AS p,
         rank() OVER (PARTITION BY scene_id ORDER BY ref) + (count(*) OVER (PARTITION BY scene_id, ref) - 1) / 2.0 AS r
  FROM m
) SELECT scene_id, round(corr(pred, ref), 6) AS pearson_r, round(corr(p, r), 6) AS spearman_r FROM ranked GROUP BY scene_id"""
)
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.correlations(metres(spark, sf_dir)))


@registry.add(
    M_SQL
    + """SELECT scene_id, round(avg(CASE WHEN h_pred > 0.5 AND h_ref > 0.5 THEN CAST(greatest(h_pred / h_ref, h_ref / h_pred) < 1.25 AS INTEGER) END), 6) AS delta1,
  count(*) FILTER (h_pred > 0.5 AND h_ref > 0.5) AS delta1_n_px FROM m GROUP BY scene_id"""
)
def delta1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.delta1(metres(spark, sf_dir), "h_pred", "h_ref"))


@registry.add(M_SQL + f"SELECT scene_id, {COVERAGE_SQL} FROM m GROUP BY scene_id")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.coverage(metres(spark, sf_dir), "err", "sigma"))


@registry.add(
    M_SQL
    + """, q AS (
  SELECT scene_id, quantile_cont(sigma, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, count(*) AS n_all FROM m WHERE sigma > 0 GROUP BY scene_id
), binned AS (
  SELECT m.scene_id, n_all, err, sigma, len(list_filter(e, lambda x: x <= sigma)) AS bin FROM m JOIN q USING (scene_id) WHERE sigma > 0
), rows AS (
  SELECT scene_id, n_all, bin, count(*) AS n, sqrt(avg(err * err)) AS rms, avg(sigma) AS mean FROM binned GROUP BY ALL
) SELECT scene_id, CASE WHEN max(n_all) >= 100 THEN round(sum(n * abs(rms - mean)) FILTER (n >= 10) / sum(n) FILTER (n >= 10), 6) END AS ece_m,
  count(*) FILTER (n >= 10) AS n_bins FROM rows GROUP BY scene_id"""
)
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.calibration_error(metres(spark, sf_dir), "err", "sigma"))


@registry.add(
    M_SQL
    + f"""SELECT * FROM (
  SELECT scene_id, sem, CAST(grouping(sem) AS INTEGER) AS overall, {ERRORS_SQL}, {COVERAGE_SQL}
  FROM m GROUP BY GROUPING SETS ((scene_id), (scene_id, sem))
) WHERE overall = 1 OR n_px >= 50"""
)
def evaluate_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(scores.evaluate_by_class(metres(spark, sf_dir)))
    return out.withColumn("overall", F.col("overall").cast("int"))


@registry.add(
    M_SQL
    + f""", e AS (SELECT scene_id, {ERRORS_SQL} FROM m GROUP BY scene_id), l AS (
  SELECT 'mae_m' AS metric, mae_m AS v FROM e UNION ALL SELECT 'rmse_m', rmse_m FROM e UNION ALL SELECT 'bias_m', bias_m FROM e
  UNION ALL SELECT 'median_ae_m', median_ae_m FROM e UNION ALL SELECT 'p90_ae_m', p90_ae_m FROM e UNION ALL SELECT 'std_m', std_m FROM e
) SELECT metric, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS least, round(max(v), 4) AS most FROM l GROUP BY metric"""
)
def aggregate_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rounded(scores.evaluate(metres(spark, sf_dir)))
    return rounded(scores.aggregate_study(records, ["mae_m", "rmse_m", "bias_m", "median_ae_m", "p90_ae_m", "std_m"]), 4)


@registry.add(
    M_SQL
    + """SELECT scene_id, round(avg(CAST(h_ref > 2 AS INTEGER)), 6) AS object_fraction, round(avg(h_ref), 6) AS true_mean_m, round(max(h_ref), 6) AS true_max_m,
  round(avg(h_pred), 6) AS pred_mean_m, round(max(h_pred), 6) AS pred_max_m FROM m GROUP BY scene_id"""
)
def relief_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.relief_report(metres(spark, sf_dir), "h_pred", "h_ref"))


@registry.add(
    M_SQL
    + f""", v AS (
  SELECT scene_id, 'method' AS variant, pred, ref FROM m UNION ALL SELECT scene_id, 'zero', 0.0, ref FROM m
  UNION ALL SELECT scene_id, 'mean', avg(ref) OVER (PARTITION BY scene_id), ref FROM m
) SELECT scene_id, variant, {ERRORS_SQL} FROM v GROUP BY scene_id, variant"""
)
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the method beside the floors of predicting zero and each scene's mean."""
    own = metres(spark, sf_dir).select("scene_id", "pred", "ref")
    mean = own.groupBy("scene_id").agg(F.avg("ref").alias("mean"))
    floor = F.array(
        F.struct(F.lit("method").alias("variant"), F.col("pred").alias("v")),
        F.struct(F.lit("zero").alias("variant"), F.lit(0.0).alias("v")),
        F.struct(F.lit("mean").alias("variant"), F.col("mean").alias("v")),
    )
    rows = own.join(F.broadcast(mean), "scene_id").select("scene_id", "ref", F.explode(floor).alias("x"))  # one row a scene
    return rounded(scores.evaluate(rows.select("scene_id", "ref", "x.variant", F.col("x.v").alias("pred")), by=("scene_id", "variant")))


@registry.add(M_SQL + "SELECT scene_id, sem, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY scene_id), 6) AS fraction FROM m GROUP BY scene_id, sem")
def class_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.class_fractions(views.px(spark, sf_dir)))


@registry.add(
    M_SQL
    + """, l AS (SELECT scene_id, 'ref' AS layer, ref AS v FROM m UNION ALL SELECT scene_id, 'pred', pred FROM m UNION ALL SELECT scene_id, 'sigma', sigma FROM m)
SELECT scene_id, layer, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.01), 6) AS p1,
  round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM l GROUP BY scene_id, layer"""
)
def finite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.finite_stats(metres(spark, sf_dir), ["ref", "pred", "sigma"]))


@registry.add(
    f"""WITH {views.PX_SQL}, s AS (SELECT scene_id, min(g) AS lo, max(g) AS hi FROM px GROUP BY scene_id), h AS (
  SELECT scene_id, lo, hi, CAST(least(floor((g - lo) / ((hi - lo) / 256.0)), 255) AS INTEGER) AS bin, count(*) AS n FROM px JOIN s USING (scene_id) GROUP BY ALL
), c AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256.0) AS c FROM h), w AS (
  SELECT scene_id, bin, c, sum(n) OVER u AS n0, sum(n * c) OVER u AS s0, sum(n) OVER (PARTITION BY scene_id) AS n_all, sum(n * c) OVER (PARTITION BY scene_id) AS s_all
  FROM c WINDOW u AS (PARTITION BY scene_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), v AS (
  SELECT scene_id, bin, c, coalesce(round(n0 * (n_all - n0) * pow(s0 / n0 - (s_all - s0) / nullif(n_all - n0, 0), 2), 6), 0) AS between_ FROM w
) SELECT scene_id, bin, round(c, 6) AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY between_ DESC, bin) = 1"""
)
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.otsu(views.px(spark, sf_dir), "g"))


@registry.add(M_SQL + "SELECT scene_id, round(sum(h_pred * h_ref) / sum(h_pred * h_pred), 6) AS target, count(*) AS n_px FROM m GROUP BY scene_id")
def scene_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.scene_target(metres(spark, sf_dir), "h_pred", "h_ref"))


@registry.add(
    M_SQL
    + """, s AS (SELECT scene_id, "row", col, ref AS z FROM m UNION ALL SELECT scene_id, "row", col, pred FROM m)
SELECT scene_id, "row", col, count(z) AS n, round(stddev_pop(z), 6) AS sigma_model FROM s GROUP BY ALL"""
)
def model_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metres(spark, sf_dir)
    both = m.select("scene_id", "row", "col", F.explode(F.array("ref", "pred")).alias("z"))
    return rounded(scores.model_sigma(both))


@registry.add(
    M_SQL
    + """SELECT scene_id, round(avg(CAST(g < 100 AS INTEGER)), 6) AS coverage, round(count(*) FILTER (g < 100 AND h_ref > 2.5) / count(*) FILTER (h_ref > 2.5), 6) AS recall,
  round(count(*) FILTER (g < 100 AND h_ref > 2.5) / count(*) FILTER (g < 100), 6) AS precision FROM m GROUP BY scene_id"""
)
def mask_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metres(spark, sf_dir)
    return rounded(scores.mask_quality(m.filter("g < 100"), m, "h_ref"))
