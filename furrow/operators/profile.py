"""Data profiles and summary aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.config import AnalysisConfig


def coverage_by_district(panel: DataFrame) -> DataFrame:
    """A10: weeks and non-missing volume / price / weather weeks per district."""
    return panel.groupBy("district").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.count("total_volume").alias("with_volume"),
        F.count("avg_fob_price").alias("with_price"),
        F.count("tmax_avg").alias("with_weather"))


def coverage_by_type(panel: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Per (year, district): weeks, weeks with volume / price / weather,
    and per commodity the weeks with volume > 0 and with a price."""
    per_type = []
    for c in cfg.commodities:
        s = cfg.suffix(c)
        per_type += [F.count_if(F.col(f"vol_{s}") > 0).alias(f"{s}_vol"),
                     F.count(f"price_{s}").alias(f"{s}_price")]
    return panel.groupBy("year", "district").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.count_if(F.col("total_volume") > 0).alias("vol_total"),
        F.count("avg_fob_price").alias("price_total"),
        F.count("tmax_avg").alias("weather"),
        *per_type)


def feed_profile(df: DataFrame, date_col: str, key_cols: Sequence[str]) -> DataFrame:
    """Rows, date range, distinct dates and distinct keys of a feed."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
        F.count_distinct(date_col).alias("distinct_dates"),
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in key_cols])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def rows_by_year(df: DataFrame, date_col: str) -> DataFrame:
    """Rows per calendar year."""
    return df.groupBy(F.year(date_col).alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def missing_days(df: DataFrame, key: str, date_col: str) -> DataFrame:
    """A12 (gap report): days between a key's first and last date without a row.

    The calendar per key comes from ``sequence`` over that key's own range;
    the anti join is keyed by (key, date), so it is partitioned, not global.
    """
    rng = df.groupBy(key).agg(F.min(date_col).alias("_a"), F.max(date_col).alias("_b"))
    days = rng.select(key, F.explode(F.sequence("_a", "_b")).alias(date_col))
    have = df.select(key, date_col).distinct()
    return days.join(have, [key, date_col], "left_anti")


def early_late_change(points: DataFrame, early_last: int, late_first: int) -> DataFrame:
    """Per commodity the mean price up to ``early_last`` vs from
    ``late_first`` on and the percent change (NULL unless both exist)."""
    y = F.year("report_date")
    g = points.groupBy("commodity").agg(
        F.avg(F.when(y <= early_last, F.col("mid"))).alias("early_mean"),
        F.avg(F.when(y >= late_first, F.col("mid"))).alias("late_mean"))
    return g.withColumn("pct_change",
                        (F.try_divide(F.col("late_mean"), F.col("early_mean")) - 1) * 100)


def dataset_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, date range, share priced, volume / price mean and median,
    coverage mean and min."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("week_ending").alias("first_week"),
        F.max("week_ending").alias("last_week"),
        F.count("price").alias("weeks_priced"),
        (F.count("price") / F.count(F.lit(1)) * 100).alias("pct_priced"),
        F.avg("volume").alias("volume_mean"),
        F.median("volume").alias("volume_median"),
        F.avg("price").alias("price_mean"),
        F.median("price").alias("price_median"),
        F.avg("coverage").alias("coverage_mean"),
        F.min("coverage").alias("coverage_min"))


def summary_statistics(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, sd, min, max and count per variable, one row per variable.

    Variables are stacked to long form first (one narrow explode), then one
    grouped aggregate computes all statistics."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"),
                                           F.col(c).cast("double").alias("value")) for c in cols]))
    long = df.select(*keys, stacked.alias("_v")).select(*keys, "_v.variable", "_v.value")
    return long.groupBy(*keys, "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"), F.min("value").alias("min"),
        F.max("value").alias("max"))


def event_shares(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Weeks with each event flag set and their share of all weeks."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("event"), F.col(c).alias("v"))
                                  for c in flags]))
    long = df.select(*keys, stacked.alias("_e")).select(*keys, "_e.event", "_e.v")
    return long.groupBy(*keys, "event").agg(
        F.sum("v").alias("weeks"), F.avg("v").alias("share"))


def seasonal_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean volume and price by (keys, ISO week)."""
    return df.groupBy(*keys, "week_of_year").agg(
        F.avg("volume").alias("volume_mean"), F.avg("price").alias("price_mean"))


def price_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of active weeks (volume > 0) that have a price."""
    active = F.col("volume") > 0
    return df.groupBy(*keys).agg(
        F.count_if(active).alias("active_weeks"),
        F.count_if(active & F.col("price").isNotNull()).alias("priced_weeks")).withColumn(
        "price_share", F.try_divide(F.col("priced_weeks"), F.col("active_weeks")))


def persistence(df: DataFrame, keys: Sequence[str], col: str = "price") -> DataFrame:
    """Lag-1 autocorrelation (Pearson correlation with the lag column)."""
    return df.groupBy(*keys).agg(F.corr(col, f"{col}_lag1").alias(f"{col}_lag1_corr"),
                                 F.count(F.col(f"{col}_lag1") * F.col(col)).alias("pairs"))


def transition_split(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in and out of transition weeks: their share, mean and sd of the price
    change, mean coverage."""
    g = dist.groupBy(*keys, "transition_week").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dprice").alias("mean_dprice"),
        F.stddev_samp("dprice").alias("sd_dprice"), F.avg("has_price").alias("mean_coverage"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
