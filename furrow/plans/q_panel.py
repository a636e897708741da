"""Panel and series queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furrow.config import DRIVER as CFG
from furrow.operators import incremental, market, panel
from furrow.plans import oracle as O
from furrow.plans.registry import register
from furrow.plans.spec import kinds
from furrow.session import ensure_checkpoint_dir
from furrow.sources import testmap
from furrow.sources.names import register_names

SFX = [CFG.suffix(c) for c in CFG.commodities]

SHIP_COLS = (kinds("week_ending:date district:str total_volume n_commodities:int")
             + [(f"vol_{s}", "dbl") for s in SFX])
PRICE_COLS = (kinds("week_ending:date district:str avg_fob_price median_fob_price n_price_obs:int")
              + [(f"price_{s}", "dbl") for s in SFX])
WX_COLS = kinds("week_ending:date district:str tmax_avg tmin_avg tmax_max tmin_min ppt_total "
                "ppt_days:int dd_heat dd_freeze n_weather_days:int tmean_avg diurnal_range "
                "extreme_heat:int freeze_risk:int heavy_rain:int")
PANEL_COLS = (SHIP_COLS + PRICE_COLS[2:] + WX_COLS[2:]
              + kinds("year:int month:int week_of_year:int state:str"))

LAGS = [f"{n}_lag{k}" for k in (1, 2, 4) for n in ("volume", "price", "tmax", "ppt")]
ROLLS = ["volume_roll4_mean", "tmax_avg_roll4_mean", "ppt_total_roll4_mean"]
MARKET_COLS = (kinds("series:str week_ending:date volume price coverage n_districts:int "
                     "tmax_avg tmin_avg tmean_avg ppt_total diurnal_range extreme_heat:int "
                     "freeze_risk:int heavy_rain:int dd_heat dd_freeze year:int month:int "
                     "week_of_year:int is_partial_year:int price_spike:int low_supply:int")
               + [(c, "dbl") for c in LAGS + ROLLS])
DISTRICT_COLS = (kinds("series:str week_ending:date district:str state:str volume price tmax_avg "
                       "tmin_avg tmax_max tmin_min ppt_total ppt_days:int tmean_avg diurnal_range "
                       "extreme_heat:int freeze_risk:int heavy_rain:int dd_heat dd_freeze year:int "
                       "month:int week_of_year:int is_partial_year:int has_price:int")
                 + [(c, "dbl") for c in LAGS + ROLLS]
                 + kinds("az_season:int ca_season:int peak_season:int"))


def feeds(spark, sf_dir):
    return testmap.feeds(spark, sf_dir)


def build_panel(spark, sf_dir):
    return panel.weekly_panel(feeds(spark, sf_dir), CFG)


# ---------------------------------------------------------------- queries

@register("shipments_weekly", SHIP_COLS,
          "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM ship_w")
def q_shipments_weekly(spark, sf_dir):
    """A1+A2: weekly volume, distinct commodities and volume pivot per district."""
    f = feeds(spark, sf_dir)
    return panel.shipments_weekly(panel.shipments_long(f["shipments"], f["shipment_map"], CFG), CFG)


@register("prices_weekly", PRICE_COLS,
          "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM price_w")
def q_prices_weekly(spark, sf_dir):
    """A3+A4, P13: midpoint price, weekly mean / exact median / count, per-type mean."""
    f = feeds(spark, sf_dir)
    return panel.prices_weekly(panel.price_points(f["prices"], f["price_map"], CFG), CFG)


@register("weather_weekly", WX_COLS,
          "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM wx_w")
def q_weather_weekly(spark, sf_dir):
    """A5+A6, P17: weekly weather aggregates, degree days and extreme flags."""
    f = feeds(spark, sf_dir)
    return panel.weather_weekly(f["weather"], f["location_map"])


@register("weekly_panel", PANEL_COLS,
          "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM panel")
def q_weekly_panel(spark, sf_dir):
    """Shipments left-joined with weekly prices and weather, plus calendar and state."""
    return build_panel(spark, sf_dir)


@register("market_series", MARKET_COLS,
          "WITH " + O.panel_cte().lstrip() + O.market_cte() + "\nSELECT * FROM market")
def q_market_series(spark, sf_dir):
    """Main-series market set with weighted price, coverage, labels, lags."""
    return market.market_series(build_panel(spark, sf_dir), CFG)


@register("market_series_all", MARKET_COLS,
          "WITH " + O.panel_cte().lstrip()
          + O.market_cte(series=list(CFG.commodities)) + "\nSELECT * FROM market")
def q_market_series_all(spark, sf_dir):
    """Market sets for every commodity at once (series is a partition key)."""
    return market.market_series(build_panel(spark, sf_dir), CFG, list(CFG.commodities))


@register("second_series", MARKET_COLS,
          "WITH " + O.panel_cte().lstrip()
          + O.market_cte(series=[CFG.second_series], round_all=False) + "\nSELECT * FROM market")
def q_second_series(spark, sf_dir):
    """M16 data: second-variety market set, only coverage rounded."""
    return market.market_series(build_panel(spark, sf_dir), CFG, [CFG.second_series],
                                round_all=False)


@register("district_series", DISTRICT_COLS,
          "WITH " + O.panel_cte().lstrip() + O.district_cte() + "\nSELECT * FROM dist")
def q_district_series(spark, sf_dir):
    """Core-district set with per-district lags and season flags."""
    return market.district_series(build_panel(spark, sf_dir), CFG)


# A configuration that knows two commodities only: the others' price columns come from the feed.
SHORT = CFG.with_(commodities=("PROMO", "STANDARD"))
FOUND_COLS = ([c for c in PANEL_COLS if not c[0].startswith("vol_") or c[0] in ("vol_promo", "vol_standard")])
_FOUND_SQL = ("WITH " + O.panel_cte(SHORT).lstrip().replace(
    "count(*) AS n_price_obs, median(fob_price) AS median_fob_price,", "count(*) AS n_price_obs, median(fob_price) AS median_fob_price,"
    + ", ".join(f"avg(CASE WHEN commodity = '{c}' THEN fob_price END) AS price_{CFG.suffix(c)}"
                for c in CFG.commodities if c not in SHORT.commodities) + ",") + "\nSELECT * FROM panel")


@register("weekly_panel_found_prices", FOUND_COLS, _FOUND_SQL)
def q_weekly_panel_found_prices(spark, sf_dir):
    """A4+P27: volumes of the configured commodities, a price column for every commodity that
    the price feed holds. Names come from a register in the shared folder, filled from the
    feed's first years, then with what the whole feed adds."""
    f = feeds(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/names-{uuid.uuid4().hex}"
    register_names(f["prices"].where(F.year("report_date") <= 1996), "commodity", path)
    return panel.weekly_panel(f, SHORT, register_names(f["prices"], "commodity", path))


def _updated(spark, sf_dir):
    """Panel and market series built without the late reports, stored by year, then updated."""
    f = feeds(spark, sf_dir)
    number = F.regexp_extract("district", r"(\d+)$", 1).cast("int")
    dates = {"shipments": "week_ending", "prices": "report_date"}
    parts = {name: f[name].withColumn("_n", number) for name in dates}
    late = {name: (F.year(d) == 1998) & (F.month(d) == 5) & (F.col("_n") % 2 == 0)
            | (F.year(d) == 1999) & (F.month(d) == 3) & (F.dayofmonth(d) <= 16) for name, d in dates.items()}
    first = f | {name: df.where(~late[name]).drop("_n") for name, df in parts.items()}
    base = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = panel.weekly_panel(first, CFG)
    before.write.partitionBy("year").parquet(f"{base}/panel")
    stored = spark.read.parquet(f"{base}/panel")
    market.market_series(stored, CFG).write.partitionBy("year").parquet(f"{base}/market")
    changed = incremental.materialize(incremental.changed_keys(
        **{name: df.where(late[name]) for name, df in parts.items()}, shipment_map=f["shipment_map"], price_map=f["price_map"]))
    now = incremental.rewrite_years(incremental.update_panel(stored, f, changed, CFG), changed, f"{base}/panel")
    series = incremental.update_market(spark.read.parquet(f"{base}/market"), now, changed, CFG)
    near = incremental.affected_weeks(now, changed).where("affected = 1").unionByName(
        changed.select("week_ending", F.lit(1).alias("affected")))
    return now, incremental.rewrite_years(series, near, f"{base}/market")


@register("weekly_panel_updated", PANEL_COLS, "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM panel")
def q_weekly_panel_updated(spark, sf_dir):
    """A stored panel that late shipments and prices update, only the changed
    (week, district) rows rebuilt, equals the one built from all reports."""
    return _updated(spark, sf_dir)[0]


@register("market_series_updated", MARKET_COLS, "WITH " + O.panel_cte().lstrip() + O.market_cte() + "\nSELECT * FROM market")
def q_market_series_updated(spark, sf_dir):
    """A stored market series that late weeks update, with the rows after them that
    their lags and windows reach, equals the one built from all reports."""
    return _updated(spark, sf_dir)[1]
