"""Series-level modelling sets built from the weekly panel.

* ``panel_cells``: the wide panel unpivoted to (series, week_ending, district)
  cells with that series' volume and price plus the district weather.
* ``market_series``: one row per (series, week) — shipment-weighted price,
  coverage, weighted weather, active districts (one grouped aggregate that
  replaces a per-week loop).
* ``district_series``: the core districts' rows per series.

Both sets then get calendar parts, risk labels, lags and rolling means from
one window sort per series (``features``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import AnalysisConfig
from furrow.functions.aggregates import weighted_mean
from furrow.functions.columns import flag, month_in, round_half_even, zero_to_null
from furrow.functions.windows import lag_columns, ordered, rolling_mean, rolling_std, trailing

WEATHER_CELL = ["tmax_avg", "tmin_avg", "tmax_max", "tmin_min", "ppt_total", "ppt_days",
                "tmean_avg", "diurnal_range", "extreme_heat", "freeze_risk", "heavy_rain",
                "dd_heat", "dd_freeze"]


def panel_cells(panel: DataFrame, cfg: AnalysisConfig, series: Sequence[str]) -> DataFrame:
    """(series, week_ending, district) rows; volume never missing, price 0 -> NULL."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(s).alias("series"),
                 F.coalesce(F.col(f"vol_{cfg.suffix(s)}"), F.lit(0.0)).alias("volume"),
                 zero_to_null(f"price_{cfg.suffix(s)}").alias("price"))
        for s in series])).alias("_c")
    keep = ["week_ending", "district", "state", "year", "month", "week_of_year"] + WEATHER_CELL
    return panel.select(*keep, cells).select("_c.*", *keep)


def _market_aggregate(cells: DataFrame, cfg: AnalysisConfig, round_all: bool) -> DataFrame:
    v, p = F.col("volume"), F.col("price")
    active = v > 0
    priced = p.isNotNull()
    rule = cfg.weighted_weather_rule
    priced_vol = F.sum(F.when(priced, v))
    g = cells.groupBy("series", "week_ending").agg(
        F.sum(v).alias("volume"),
        F.when(priced_vol > 0, F.sum(F.when(priced, v * p)) / priced_vol).alias("price"),
        F.coalesce(F.when(priced_vol > 0, priced_vol), F.lit(0.0)).alias("_priced_vol"),
        F.count_if(active).alias("n_districts"),
        *[weighted_mean(c, "volume", active, rule).alias(f"_w_{c}")
          for c in ("tmax_avg", "tmin_avg", "ppt_total", "dd_heat", "dd_freeze")],
        *[F.when(F.count_if(active) > 0, F.max(F.when(active, F.col(c)))).otherwise(F.lit(0))
          .alias(c) for c in ("extreme_heat", "freeze_risk", "heavy_rain")],
    )
    cov = F.when(F.col("volume") > 0, F.col("_priced_vol") / F.col("volume")).otherwise(F.lit(0.0))
    r2 = (lambda c: round_half_even(c, 2)) if round_all else (lambda c: c)
    r3 = (lambda c: round_half_even(c, 3)) if round_all else (lambda c: c)
    wt, wn = F.col("_w_tmax_avg"), F.col("_w_tmin_avg")
    return g.select(
        "series", "week_ending", "volume", "price",
        round_half_even(cov, 3).alias("coverage"),
        F.col("n_districts").cast("int").alias("n_districts"),
        r2(wt).alias("tmax_avg"),
        r2(wn).alias("tmin_avg"),
        r2((wt + wn) / 2).alias("tmean_avg"),
        r3(F.col("_w_ppt_total")).alias("ppt_total"),
        r2(wt - wn).alias("diurnal_range"),
        F.col("extreme_heat").cast("int").alias("extreme_heat"),
        F.col("freeze_risk").cast("int").alias("freeze_risk"),
        F.col("heavy_rain").cast("int").alias("heavy_rain"),
        r3(F.col("_w_dd_heat")).alias("dd_heat"),
        r3(F.col("_w_dd_freeze")).alias("dd_freeze"),
    )


def add_market_features(m: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Calendar, risk labels, lags and rolling means (one window per series)."""
    w = ordered(["series"], "week_ending")
    rows, need = K.LABEL_WINDOW
    w8 = trailing(["series"], "week_ending", rows)
    roll_rows, roll_need = K.ROLL_WINDOW
    w4 = trailing(["series"], "week_ending", roll_rows)
    pm, ps = rolling_mean("price", w8, need), rolling_std("price", w8, need)
    vm, vs = rolling_mean("volume", w8, need), rolling_std("volume", w8, need)
    year = F.year("week_ending")
    return m.select(
        "*",
        year.alias("year"),
        F.month("week_ending").alias("month"),
        F.weekofyear("week_ending").alias("week_of_year"),
        flag(year == cfg.partial_year).alias("is_partial_year"),
        flag(F.col("price") > pm + K.SPIKE_SD * ps).alias("price_spike"),
        flag(F.col("volume") < vm - K.LOW_SUPPLY_SD * vs).alias("low_supply"),
        *lag_columns(["volume", "price", "tmax_avg", "ppt_total"], K.LAGS, w,
                     {"tmax_avg": "tmax", "ppt_total": "ppt"}),
        *[rolling_mean(c, w4, roll_need).alias(f"{c}_roll4_mean")
          for c in ("volume", "tmax_avg", "ppt_total")],
    )


def market_series(panel: DataFrame, cfg: AnalysisConfig, series: Sequence[str] | None = None,
                  round_all: bool = True) -> DataFrame:
    """Market set: one row per (series, week) of the panel, with features.

    ``round_all=False`` rounds only coverage (the second-variety variant).
    """
    series = list(series or [cfg.main_series])
    cells = panel_cells(panel, cfg, series)
    return add_market_features(_market_aggregate(cells, cfg, round_all), cfg)


def district_series(panel: DataFrame, cfg: AnalysisConfig,
                    series: Sequence[str] | None = None) -> DataFrame:
    """District set: core districts, per-district lags/rolls, season flags."""
    series = list(series or [cfg.main_series])
    cells = (panel_cells(panel, cfg, series)
             .where(F.col("district").isin(list(cfg.core_districts))))
    keys = ["series", "district"]
    w = ordered(keys, "week_ending")
    roll_rows, roll_need = K.ROLL_WINDOW
    w4 = trailing(keys, "week_ending", roll_rows)
    az = flag((F.col("state") == "AZ") & F.col("month").isin(K.AZ_SEASON_MONTHS))
    ca = flag((F.col("state") == "CA") & F.col("month").isin(K.CA_SEASON_MONTHS))
    return cells.select(
        "series", "week_ending", "district", "state", "volume", "price",
        "tmax_avg", "tmin_avg", "tmax_max", "tmin_min", "ppt_total", "ppt_days",
        "tmean_avg", "diurnal_range", "extreme_heat", "freeze_risk", "heavy_rain",
        "dd_heat", "dd_freeze", "year", "month", "week_of_year",
        flag(F.col("year") == cfg.partial_year).alias("is_partial_year"),
        flag(F.col("price").isNotNull()).alias("has_price"),
        *lag_columns(["volume", "price", "tmax_avg", "ppt_total"], K.LAGS, w,
                     {"tmax_avg": "tmax", "ppt_total": "ppt"}),
        *[rolling_mean(c, w4, roll_need).alias(f"{c}_roll4_mean")
          for c in ("volume", "tmax_avg", "ppt_total")],
        az.alias("az_season"),
        ca.alias("ca_season"),
        flag((az == 1) | (ca == 1)).alias("peak_season"),
    )
