"""Profile queries (A10-A15, A17, A19, A20), all with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.config import DRIVER as CFG
from furrow.operators import market, panel
from furrow.operators import profile as P
from furrow.plans import oracle as O
from furrow.plans.q_panel import build_panel, feeds
from furrow.plans.registry import register
from furrow.plans.spec import kinds

SFX = [CFG.suffix(c) for c in CFG.commodities]
PANEL_SQL = "WITH " + O.panel_cte().lstrip()
MARKET_SQL = PANEL_SQL + O.market_cte()


@register("coverage_by_district", kinds("district:str weeks:int with_volume:int with_price:int "
                                        "with_weather:int"),
          PANEL_SQL + """
SELECT district, count(*) AS weeks, count(total_volume) AS with_volume,
       count(avg_fob_price) AS with_price, count(tmax_avg) AS with_weather
FROM panel GROUP BY 1""")
def q_coverage_by_district(spark, sf_dir):
    """A10: weeks with volume, price and weather per district."""
    return P.coverage_by_district(build_panel(spark, sf_dir))


_TYPE_COLS = kinds("year:int district:str weeks:int vol_total:int price_total:int weather:int") + [
    (f"{s}_{k}", "int") for s in SFX for k in ("vol", "price")]


@register("coverage_by_type", _TYPE_COLS, PANEL_SQL + """
SELECT year, district, count(*) AS weeks, count(*) FILTER (WHERE total_volume > 0) AS vol_total,
       count(avg_fob_price) AS price_total, count(tmax_avg) AS weather, """
          + ", ".join(f"count(*) FILTER (WHERE vol_{s} > 0) AS {s}_vol, count(price_{s}) AS {s}_price"
                      for s in SFX) + """
FROM panel GROUP BY 1, 2""")
def q_coverage_by_type(spark, sf_dir):
    """Per year and district, weeks with volume / price for every commodity."""
    return P.coverage_by_type(build_panel(spark, sf_dir), CFG)


@register("shipment_feed_profile", kinds("rows:int first_date:date last_date:date distinct_dates:int "
                                         "distinct_district:int distinct_commodity:int"),
          "WITH " + O.feeds_cte().lstrip() + """
SELECT count(*) AS rows, min(week_ending) AS first_date, max(week_ending) AS last_date,
       count(DISTINCT week_ending) AS distinct_dates, count(DISTINCT district) AS distinct_district,
       count(DISTINCT commodity) AS distinct_commodity FROM ship""")
def q_ship_profile(spark, sf_dir):
    """Shipment feed rows, date range, distinct weeks, districts and commodities."""
    return P.feed_profile(feeds(spark, sf_dir)["shipments"], "week_ending", ["district", "commodity"])


@register("price_rows_by_year", kinds("year:int rows:int"),
          "WITH " + O.feeds_cte().lstrip() + """
SELECT year(report_date) AS year, count(*) AS rows FROM price_rows GROUP BY 1""")
def q_price_by_year(spark, sf_dir):
    """Price report rows per year."""
    return P.rows_by_year(feeds(spark, sf_dir)["prices"], "report_date")


@register("shipment_district_counts", kinds("district:str rows:int"),
          "WITH " + O.feeds_cte().lstrip() + "\nSELECT district, count(*) AS rows FROM ship GROUP BY 1")
def q_ship_district_counts(spark, sf_dir):
    """Shipment rows per raw district (value counts)."""
    return P.value_counts(feeds(spark, sf_dir)["shipments"], "district")


@register("weather_missing_days", kinds("location:str date:date"),
          "WITH " + O.feeds_cte().lstrip() + """,
rng AS (SELECT location, min(date) AS a, max(date) AS b FROM wx_rows GROUP BY 1),
days AS (SELECT location, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM rng)
SELECT d.location, d.date FROM days d
WHERE NOT EXISTS (SELECT 1 FROM wx_rows w WHERE w.location = d.location AND w.date = d.date)""")
def q_weather_gaps(spark, sf_dir):
    """A12 (gap report): days inside each location's range with no weather reading."""
    return P.missing_days(feeds(spark, sf_dir)["weather"], "location", "date")


@register("early_late_price_change", kinds("commodity:str early_mean late_mean pct_change"),
          "WITH " + O.feeds_cte().lstrip() + f"""
SELECT commodity, avg(CASE WHEN year(report_date) <= {CFG.price_early_last} THEN mid END) AS early_mean,
       avg(CASE WHEN year(report_date) >= {CFG.price_late_first} THEN mid END) AS late_mean,
       (avg(CASE WHEN year(report_date) >= {CFG.price_late_first} THEN mid END)
        / avg(CASE WHEN year(report_date) <= {CFG.price_early_last} THEN mid END) - 1) * 100
         AS pct_change
FROM (SELECT report_date, commodity, (mostly_low_price + mostly_high_price) / 2.0 AS mid
      FROM price_rows WHERE organic <> '{CFG.organic_flag}'
        AND mostly_low_price IS NOT NULL AND mostly_high_price IS NOT NULL)
GROUP BY 1""")
def q_early_late(spark, sf_dir):
    """Mean 'mostly' midpoint per commodity, early vs late years, % change."""
    pts = panel.mostly_midpoints(feeds(spark, sf_dir)["prices"], CFG)
    return P.early_late_change(pts, CFG.price_early_last, CFG.price_late_first)


@register("market_profile", kinds("series:str rows:int first_week:date last_week:date weeks_priced:int "
                                   "pct_priced volume_mean volume_median price_mean price_median "
                                   "coverage_mean coverage_min"),
          MARKET_SQL + """
SELECT series, count(*) AS rows, min(week_ending) AS first_week, max(week_ending) AS last_week,
       count(price) AS weeks_priced, count(price) / count(*) * 100 AS pct_priced,
       avg(volume) AS volume_mean, median(volume) AS volume_median, avg(price) AS price_mean,
       median(price) AS price_median, avg(coverage) AS coverage_mean, min(coverage) AS coverage_min
FROM market GROUP BY 1""")
def q_market_profile(spark, sf_dir):
    """Market set profile."""
    return P.dataset_profile(market.market_series(build_panel(spark, sf_dir), CFG), ["series"])


SUMMARY_VARS = ["price", "volume", "coverage", "tmax_avg", "tmin_avg", "ppt_total", "dd_heat",
                "dd_freeze", "n_districts"]


@register("summary_statistics", kinds("series:str variable:str n:int mean sd min max"),
          MARKET_SQL + "\n" + "\nUNION ALL\n".join(
              f"SELECT series, '{v}' AS variable, count({v}) AS n, avg({v}) AS mean, "
              f"stddev_samp({v}) AS sd, min({v}) AS min, max({v}) AS max FROM market GROUP BY 1"
              for v in SUMMARY_VARS))
def q_summary(spark, sf_dir):
    """Mean, sd, min, max per variable of the market set (stacked long)."""
    return P.summary_statistics(market.market_series(build_panel(spark, sf_dir), CFG), ["series"],
                                SUMMARY_VARS)


EVENTS = ["extreme_heat", "freeze_risk", "heavy_rain", "price_spike", "low_supply"]


@register("event_shares", kinds("series:str event:str weeks:int share"),
          MARKET_SQL + "\n" + "\nUNION ALL\n".join(
              f"SELECT series, '{e}' AS event, sum({e}) AS weeks, avg({e}) AS share FROM market GROUP BY 1"
              for e in EVENTS))
def q_event_shares(spark, sf_dir):
    """Number and share of event weeks (heat, freeze, rain, spikes, low supply)."""
    return P.event_shares(market.market_series(build_panel(spark, sf_dir), CFG), ["series"], EVENTS)


@register("seasonal_profile", kinds("series:str district:str week_of_year:int volume_mean price_mean"),
          PANEL_SQL + O.district_cte() + """
SELECT series, district, week_of_year, avg(volume) AS volume_mean, avg(price) AS price_mean
FROM dist GROUP BY 1, 2, 3""")
def q_seasonal(spark, sf_dir):
    """Mean volume and price by district and ISO week."""
    return P.seasonal_profile(market.district_series(build_panel(spark, sf_dir), CFG),
                              ["series", "district"])


@register("district_price_share", kinds("series:str district:str active_weeks:int priced_weeks:int "
                                        "price_share"),
          PANEL_SQL + O.district_cte() + """
SELECT series, district, count(*) FILTER (WHERE volume > 0) AS active_weeks,
       count(*) FILTER (WHERE volume > 0 AND price IS NOT NULL) AS priced_weeks,
       CAST(count(*) FILTER (WHERE volume > 0 AND price IS NOT NULL) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE volume > 0), 0) AS price_share
FROM dist GROUP BY 1, 2""")
def q_price_share(spark, sf_dir):
    """Share of active district-weeks with a price."""
    return P.price_share(market.district_series(build_panel(spark, sf_dir), CFG),
                         ["series", "district"])


@register("price_persistence", kinds("series:str price_lag1_corr pairs:int"),
          MARKET_SQL + """
SELECT series, corr(price, price_lag1) AS price_lag1_corr,
       count(price * price_lag1) AS pairs FROM market GROUP BY 1""")
def q_persistence(spark, sf_dir):
    """Lag-1 autocorrelation of the market price."""
    return P.persistence(market.market_series(build_panel(spark, sf_dir), CFG), ["series"])
