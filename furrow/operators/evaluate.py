"""Forecast diagnostics over a predictions table.

A predictions table has keys (e.g. series, model), year, week_ending,
actual, pred_level and optionally coverage. Every diagnostic is a grouped
aggregate over it; medians use the skew-safe exact median.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import config as K
from furrow.functions.aggregates import exact_median
from furrow.functions.columns import bin_label, bin_order


def prediction_table(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """actual, predicted, coverage, abs / pct / signed error."""
    e = F.col("actual") - F.col("pred_level")
    return preds.select(
        *keys, "year", "week_ending", "actual", F.col("pred_level").alias("predicted"), "coverage",
        F.abs(e).alias("abs_error"),
        (F.try_divide(F.abs(e), F.col("actual")) * 100).alias("pct_error"),
        e.alias("signed_error"),
    )


def error_by_coverage(table: DataFrame, keys: Sequence[str], bins=K.COVERAGE_BINS,
                      closed: str = "left") -> DataFrame:
    """F8: n, MAE, median error and MAPE per coverage bin (empty bins absent)."""
    keys = list(keys)
    t = table.select(*keys, "abs_error", "pct_error",
                     bin_label("coverage", bins, closed).alias("coverage_bin"),
                     bin_order("coverage", bins, closed).alias("bin_order"))
    t = t.where(F.col("coverage_bin").isNotNull())
    g = t.groupBy(*keys, "coverage_bin", "bin_order").agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"),
        F.avg("pct_error").alias("mape"))
    med = exact_median(t, keys + ["coverage_bin"], "abs_error", "median_error")
    return g.join(med, keys + ["coverage_bin"], "left")


def extreme_year_split(table: DataFrame, keys: Sequence[str], year: int) -> DataFrame:
    """F9 (errors): MAE and max error in one year vs all other years."""
    grp = F.when(F.col("year") == year, F.lit(str(year))).otherwise(F.lit("other"))
    return table.groupBy(*keys, grp.alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"),
        F.max("abs_error").alias("max_error"))


def year_price_profile(market: DataFrame, keys: Sequence[str], year: int) -> DataFrame:
    """F9 (prices): mean, max, std and spike count of the price in one year."""
    return (market.where(F.col("year") == year).groupBy(*keys).agg(
        F.avg("price").alias("price_mean"), F.max("price").alias("price_max"),
        F.stddev_samp("price").alias("price_std"), F.sum("price_spike").alias("price_spikes")))


def period_errors(table: DataFrame, keys: Sequence[str], last_early_year: int) -> DataFrame:
    """RMSE, MAE, MAPE for early years, late years and all (labels by explode)."""
    early = F.lit(f"<= {last_early_year}")
    late = F.lit(f">= {last_early_year + 1}")
    lab = F.explode(F.array(F.when(F.col("year") <= last_early_year, early).otherwise(late),
                            F.lit("All"))).alias("period")
    t = table.select(*keys, "abs_error", "pct_error", lab)
    return t.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))).alias("rmse"),
        F.avg("abs_error").alias("mae"), F.avg("pct_error").alias("mape"))


def partial_year_sensitivity(table: DataFrame, keys: Sequence[str], partial_year: int,
                             negligible: float = 0.1) -> DataFrame:
    """overall RMSE with and without the partial year."""
    sq = F.col("abs_error") * F.col("abs_error")
    part = F.col("year") == partial_year
    g = table.groupBy(*keys).agg(
        F.count_if(part).alias("n_partial"),
        F.avg(F.when(part, F.col("abs_error"))).alias("mae_partial"),
        F.avg(F.when(part, F.col("pct_error"))).alias("mape_partial"),
        F.sqrt(F.avg(sq)).alias("rmse_with"),
        F.sqrt(F.avg(F.when(~part, sq))).alias("rmse_without"))
    return g.withColumn("negligible", (F.abs(F.col("rmse_with") - F.col("rmse_without")) < negligible)
                        .cast("int"))


def volatile_years(market: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Yearly price mean / max / std, the k most volatile years per key."""
    from pyspark.sql import Window
    g = market.groupBy(*keys, "year").agg(
        F.avg("price").alias("price_mean"), F.max("price").alias("price_max"),
        F.stddev_samp("price").alias("price_std"))
    w = Window.partitionBy(*keys).orderBy(F.col("price_std").desc_nulls_last(), F.col("year"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def improvement(scores: DataFrame, keys: Sequence[str], base_model: str, other_model: str) -> DataFrame:
    """Per fold, RMSE of two models side by side and the % gain of the second."""
    keys = list(keys)
    a = scores.where(F.col("model") == base_model).select(
        *keys, "year", F.col("n").alias("n_test"), F.col("rmse").alias("base_rmse"),
        F.col("mae").alias("base_mae"))
    b = scores.where(F.col("model") == other_model).select(
        *keys, "year", F.col("rmse").alias("other_rmse"), F.col("mae").alias("other_mae"))
    j = a.join(b, keys + ["year"], "full")
    return j.withColumn("improvement", F.try_divide(F.col("base_rmse") - F.col("other_rmse"),
                                                    F.col("base_rmse")) * 100)


def compare_folds(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  names=("expanding", "rolling")) -> DataFrame:
    """Two fold-score tables joined by year (left drives)."""
    keys = list(keys)
    a, b = names
    lcols = [F.col(c).alias(f"{a}_{c}") for c in ("rmse", "mae")]
    rcols = [F.col(c).alias(f"{b}_{c}") for c in ("rmse", "mae")]
    return left.select(*keys, "year", *lcols).join(right.select(*keys, "year", *rcols),
                                                   keys + ["year"], "left")
