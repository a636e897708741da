"""Weekly (week_ending, district) panel: shipments ⟕ prices ⟕ weather.

Every raw feed is reduced exactly once by a hash aggregate keyed on
(week_ending, district[, commodity]) with map-side partial aggregation; all
later steps work on those small weekly tables. District maps are dimension
tables joined by a size-checked broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import config as K
from furrow.config import AnalysisConfig
from furrow.functions.aggregates import exact_median
from furrow.functions.columns import (
    degree_days_above, degree_days_below, flag, midpoint_with_fallback, state_label,
    week_ending_tuesday,
)

KEY = ["week_ending", "district"]


def _map_district(df: DataFrame, mapping: DataFrame, col: str = "district") -> DataFrame:
    """Replace the raw name by the mapped one; unmatched rows are dropped."""
    m = mapping.select(F.col("raw").alias("_raw"), F.col("std").alias("_std"))
    return (df.join(m, df[col] == m["_raw"], "inner")
              .drop(col, "_raw").withColumnRenamed("_std", col))


# ---------------------------------------------------------------- shipments

def shipments_long(shipments: DataFrame, shipment_map: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """(week_ending, district, commodity) -> volume, for the main commodities."""
    s = (shipments.select("week_ending", "district", "commodity", "volumes")
                  .where(F.col("week_ending").isNotNull() & F.col("volumes").isNotNull())
                  .where(F.col("commodity").isin(list(cfg.commodities))))
    s = _map_district(s, shipment_map)
    return s.groupBy(*KEY, "commodity").agg(F.sum("volumes").alias("volume"))


def shipments_weekly(ship_long: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Totals, distinct commodities and the volume pivot (absent -> 0)."""
    vol_cols = [F.coalesce(F.sum(F.when(F.col("commodity") == c, F.col("volume"))), F.lit(0.0))
                 .alias(f"vol_{cfg.suffix(c)}") for c in cfg.commodities]
    return ship_long.groupBy(*KEY).agg(
        F.sum("volume").alias("total_volume"),
        F.count(F.lit(1)).alias("n_commodities"),
        *vol_cols,
    )


# ------------------------------------------------------------------- prices

def price_points(prices: DataFrame, price_map: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Non-organic price reports -> (week_ending, district, commodity, fob_price)."""
    p = prices.select("report_date", "district", "commodity", "organic", "low_price",
                      "high_price", "mostly_low_price", "mostly_high_price")
    p = p.where(F.col("organic") == cfg.organic_keep)
    p = _map_district(p, price_map)
    price_cols = ("mostly_low_price", "mostly_high_price", "low_price", "high_price")
    text = any(isinstance(p.schema[c].dataType, T.StringType) for c in price_cols)
    fob = midpoint_with_fallback(*price_cols, text=text)
    return (p.select(week_ending_tuesday("report_date").alias("week_ending"), "district",
                     "commodity", fob.alias("fob_price"))
             .where(F.col("fob_price").isNotNull() & F.col("week_ending").isNotNull()))


def mostly_midpoints(prices: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """(report_date, commodity, mid): midpoint of the 'mostly' prices of reports not flagged organic."""
    def number(c):
        text = isinstance(prices.schema[c].dataType, T.StringType)
        x = F.trim(F.col(c)).try_cast("double") if text else F.col(c).cast("double")
        return F.nanvl(x, F.lit(None).cast("double"))

    mid = (number("mostly_low_price") + number("mostly_high_price")) / 2.0
    return (prices.where(F.coalesce(F.col("organic"), F.lit("N")) != cfg.organic_flag)
            .select("report_date", "commodity", mid.alias("mid")).where(F.col("mid").isNotNull()))


def prices_weekly(points: DataFrame, cfg: AnalysisConfig, names: Sequence[str] | None = None) -> DataFrame:
    """Mean, exact median and count over all reports plus the mean per commodity
    of ``names`` (else the configured ones; ``sources.names`` keeps a register of
    those found). Mean, count and commodity means are one partial aggregate straight
    from the points; the median shuffles only values near the middle. Names that
    normalise to the same column are averaged together."""
    columns: dict[str, list[str]] = {}
    for c in (cfg.commodities if names is None else names):
        columns.setdefault(f"price_{cfg.suffix(c)}", []).append(c)
    types = [F.avg(F.when(F.col("commodity").isin(own), F.col("fob_price"))).alias(column)
             for column, own in columns.items()]
    weekly = points.groupBy(*KEY).agg(F.avg("fob_price").alias("avg_fob_price"),
                                      F.count(F.lit(1)).alias("n_price_obs"), *types)
    return weekly.join(exact_median(points, KEY, "fob_price", "median_fob_price"), KEY, "left")


# ------------------------------------------------------------------ weather

def weather_daily(weather: DataFrame, location_map: DataFrame) -> DataFrame:
    """Daily readings mapped to districts (unmapped dropped) with degree days."""
    lm = location_map.select(F.col("location").alias("_loc"), "district")
    w = (weather.select("location", "date", "tmax", "tmin", "ppt")
                .join(lm, F.col("location") == F.col("_loc"), "left")
                .where(F.col("district").isNotNull()))
    return w.select(
        "date", "district", "tmax", "tmin", "ppt",
        degree_days_above("tmax", K.HEAT_DAY_BASE).alias("dd_heat"),
        degree_days_below("tmin", K.FREEZE_DAY_BASE).alias("dd_freeze"),
    )


def weather_aggregates() -> list:
    """Weekly aggregate expressions over daily rows (shared by batch and stream)."""
    return [
        F.avg("tmax").alias("tmax_avg"),
        F.avg("tmin").alias("tmin_avg"),
        F.max("tmax").alias("tmax_max"),
        F.min("tmin").alias("tmin_min"),
        F.coalesce(F.sum("ppt"), F.lit(0.0)).alias("ppt_total"),
        F.count_if(F.col("ppt") > 0).alias("ppt_days"),
        F.coalesce(F.sum("dd_heat"), F.lit(0.0)).alias("dd_heat"),
        F.coalesce(F.sum("dd_freeze"), F.lit(0.0)).alias("dd_freeze"),
        F.count("tmax").alias("n_weather_days"),
    ]


def weather_derived(g: DataFrame) -> DataFrame:
    """Mean temperature, diurnal range and the three extreme-week flags."""
    return g.select(
        "*",
        ((F.col("tmax_avg") + F.col("tmin_avg")) / 2).alias("tmean_avg"),
        (F.col("tmax_avg") - F.col("tmin_avg")).alias("diurnal_range"),
        flag(F.col("tmax_max") > K.EXTREME_HEAT_ABOVE).alias("extreme_heat"),
        flag(F.col("tmin_min") < K.FREEZE_RISK_BELOW).alias("freeze_risk"),
        flag(F.col("ppt_total") > K.HEAVY_RAIN_ABOVE).alias("heavy_rain"),
    )


def weather_weekly(weather: DataFrame, location_map: DataFrame) -> DataFrame:
    """Daily readings -> weekly means, extremes, sums, rainy days, flags."""
    d = weather_daily(weather, location_map)
    d = d.select(week_ending_tuesday("date").alias("week_ending"), *[c for c in d.columns if c != "date"])
    g = d.where(F.col("week_ending").isNotNull()).groupBy(*KEY).agg(*weather_aggregates())
    return weather_derived(g)


# -------------------------------------------------------------------- panel

def weekly_panel(feeds: dict[str, DataFrame], cfg: AnalysisConfig, price_names: Sequence[str] | None = None) -> DataFrame:
    """The (week_ending, district) panel; shipments drive the left joins. A price
    column for each of ``price_names``, else for the configured commodities."""
    ship = shipments_weekly(shipments_long(feeds["shipments"], feeds["shipment_map"], cfg), cfg)
    price = prices_weekly(price_points(feeds["prices"], feeds["price_map"], cfg), cfg, price_names)
    wx = weather_weekly(feeds["weather"], feeds["location_map"])
    return join_panel(ship, price, wx, cfg)


def join_panel(ship: DataFrame, price: DataFrame, wx: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The three weekly tables joined, with calendar and state. Tables bucketed by
    (week_ending, district), see ``sources.feeds.write_bucketed``, join without a shuffle."""
    panel = ship.join(price, KEY, "left").join(wx, KEY, "left")
    return panel.select(
        "*",
        F.year("week_ending").alias("year"),
        F.month("week_ending").alias("month"),
        F.weekofyear("week_ending").alias("week_of_year"),
        state_label("district", cfg.az_districts).alias("state"),
    )
