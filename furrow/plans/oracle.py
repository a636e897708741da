"""DuckDB SQL for the oracle check, written from the semantics (not the
Spark plan). Fragments are common table expressions over the pre-registered
test tables; each registered query composes them and selects its output.
"""

from __future__ import annotations

from furrow import config as K
from furrow.config import DRIVER, AnalysisConfig

CFG = DRIVER


def wk(d: str) -> str:
    """Tuesday week end of a date or timestamp."""
    return f"(CAST({d} AS DATE) + CAST((9 - isodow(CAST({d} AS DATE))) % 7 AS INTEGER))"


def _in(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def feeds_cte(cfg: AnalysisConfig = CFG) -> str:
    return f"""
geo AS (
  SELECT s_suppkey, s_name, n_name, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
li AS (
  SELECT l.*, geo.s_name, geo.n_name, geo.r_name, p_type, p_brand, p_size,
         l_extendedprice / l_quantity AS unit_price
  FROM lineitem l JOIN geo ON l.l_suppkey = geo.s_suppkey JOIN part ON l.l_partkey = p_partkey),
dmap AS (
  SELECT n_name AS raw, r_name AS std FROM nation JOIN region ON n_regionkey = r_regionkey),
ship AS (
  SELECT {wk('l_shipdate')} AS week_ending, r_name AS region, s_name AS origin,
         n_name AS district, p_type AS commodity, CAST(l_quantity AS DOUBLE) AS volumes
  FROM li),
price_rows AS (
  SELECT CAST(l_shipdate AS DATE) AS report_date, n_name AS district, p_type AS commodity,
         p_brand AS variety, 'carton' AS package, CAST(p_size AS VARCHAR) AS item_size,
         l_returnflag AS organic,
         unit_price * (1 - l_discount) AS low_price,
         unit_price * (1 + l_tax) AS high_price,
         CASE WHEN l_discount <> 0 THEN unit_price END AS mostly_low_price,
         CASE WHEN l_discount <> 0 THEN unit_price END AS mostly_high_price
  FROM li),
wx_rows AS (
  SELECT r_name AS location, CAST(o_orderdate AS DATE) AS date,
         CAST((o_custkey * 37) % 250 AS DOUBLE) / 10.0::DOUBLE - 1.0::DOUBLE
           + o_totalprice / 20000.0::DOUBLE AS tmax,
         CAST((o_custkey * 37) % 250 AS DOUBLE) / 10.0::DOUBLE - 1.0::DOUBLE AS tmin,
         CAST((o_orderkey * 13) % 7 AS DOUBLE) AS ppt
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _suffix(cfg, c):
    return cfg.suffix(c)


def panel_cte(cfg: AnalysisConfig = CFG) -> str:
    comms = list(cfg.commodities)
    vol_cols = ",\n         ".join(
        f"coalesce(sum(CASE WHEN commodity = '{c}' THEN volume END), 0.0) AS vol_{_suffix(cfg, c)}"
        for c in comms)
    price_cols = ",\n         ".join(
        f"avg(CASE WHEN commodity = '{c}' THEN fob_price END) AS price_{_suffix(cfg, c)}"
        for c in comms)
    az = _in(cfg.az_districts)
    return feeds_cte(cfg) + f""",
ship_long AS (
  SELECT s.week_ending, m.std AS district, s.commodity, sum(s.volumes) AS volume
  FROM ship s JOIN dmap m ON s.district = m.raw
  WHERE s.week_ending IS NOT NULL AND s.volumes IS NOT NULL AND s.commodity IN {_in(comms)}
  GROUP BY 1, 2, 3),
ship_w AS (
  SELECT week_ending, district, sum(volume) AS total_volume, count(*) AS n_commodities,
         {vol_cols}
  FROM ship_long GROUP BY 1, 2),
pts AS (
  SELECT {wk('p.report_date')} AS week_ending, m.std AS district, p.commodity,
         coalesce((p.mostly_low_price + p.mostly_high_price) / 2.0,
                  (p.low_price + p.high_price) / 2.0) AS fob_price
  FROM price_rows p JOIN dmap m ON p.district = m.raw
  WHERE p.organic = '{cfg.organic_keep}'),
price_w AS (
  SELECT week_ending, district, avg(fob_price) AS avg_fob_price,
         count(*) AS n_price_obs, median(fob_price) AS median_fob_price,
         {price_cols}
  FROM pts WHERE fob_price IS NOT NULL AND week_ending IS NOT NULL GROUP BY 1, 2),
wx_days AS (
  SELECT {wk('w.date')} AS week_ending, l.district, w.tmax, w.tmin, w.ppt,
         CASE WHEN w.tmax IS NOT NULL THEN greatest(w.tmax - {K.HEAT_DAY_BASE}, 0.0) END AS dd_heat,
         CASE WHEN w.tmin IS NOT NULL THEN greatest({K.FREEZE_DAY_BASE} - w.tmin, 0.0) END AS dd_freeze
  FROM wx_rows w LEFT JOIN (SELECT r_name AS location, r_name AS district FROM region) l
       ON w.location = l.location
  WHERE l.district IS NOT NULL),
wx_w0 AS (
  SELECT week_ending, district, avg(tmax) AS tmax_avg, avg(tmin) AS tmin_avg,
         max(tmax) AS tmax_max, min(tmin) AS tmin_min, coalesce(sum(ppt), 0.0) AS ppt_total,
         count(*) FILTER (WHERE ppt > 0) AS ppt_days,
         coalesce(sum(dd_heat), 0.0) AS dd_heat, coalesce(sum(dd_freeze), 0.0) AS dd_freeze,
         count(tmax) AS n_weather_days
  FROM wx_days WHERE week_ending IS NOT NULL GROUP BY 1, 2),
wx_w AS (
  SELECT *, (tmax_avg + tmin_avg) / 2 AS tmean_avg, tmax_avg - tmin_avg AS diurnal_range,
         CASE WHEN tmax_max > {K.EXTREME_HEAT_ABOVE} THEN 1 ELSE 0 END AS extreme_heat,
         CASE WHEN tmin_min < {K.FREEZE_RISK_BELOW} THEN 1 ELSE 0 END AS freeze_risk,
         CASE WHEN ppt_total > {K.HEAVY_RAIN_ABOVE} THEN 1 ELSE 0 END AS heavy_rain
  FROM wx_w0),
panel AS (
  SELECT s.*, p.* EXCLUDE (week_ending, district), w.* EXCLUDE (week_ending, district),
         year(s.week_ending) AS year, month(s.week_ending) AS month,
         weekofyear(s.week_ending) AS week_of_year,
         CASE WHEN s.district IN {az} THEN 'AZ' ELSE 'CA' END AS state
  FROM ship_w s
  LEFT JOIN price_w p ON s.week_ending = p.week_ending AND s.district = p.district
  LEFT JOIN wx_w w ON s.week_ending = w.week_ending AND s.district = w.district)"""


def cells_sql(cfg: AnalysisConfig, series) -> str:
    parts = []
    for s in series:
        sfx = _suffix(cfg, s)
        parts.append(f"""
  SELECT '{s}' AS series, week_ending, district, state, year, month, week_of_year,
         coalesce(vol_{sfx}, 0.0) AS volume,
         CASE WHEN price_{sfx} <> 0 THEN price_{sfx} END AS price,
         tmax_avg, tmin_avg, tmax_max, tmin_min, ppt_total, ppt_days, tmean_avg, diurnal_range,
         extreme_heat, freeze_risk, heavy_rain, dd_heat, dd_freeze
  FROM panel""")
    return "\n  UNION ALL".join(parts)


def market_cte(cfg: AnalysisConfig = CFG, series=None, round_all: bool = True,
               name: str = "market") -> str:
    series = list(series or [cfg.main_series])
    r2 = (lambda e: f"(round_even(({e}) * 100.0, 0) / 100.0)") if round_all else (lambda e: e)
    r3 = (lambda e: f"(round_even(({e}) * 1000.0, 0) / 1000.0)") if round_all else (lambda e: e)

    def wmean(c):
        return (f"coalesce(sum(CASE WHEN volume > 0 THEN volume * {c} END), 0.0)"
                f" / sum(CASE WHEN volume > 0 THEN volume END)")

    def wflag(c):
        return (f"CASE WHEN count(*) FILTER (WHERE volume > 0) > 0 "
                f"THEN max(CASE WHEN volume > 0 THEN {c} END) ELSE 0 END")

    rows, need = K.LABEL_WINDOW
    rr, rneed = K.ROLL_WINDOW
    lag_cols = []
    for k in K.LAGS:
        for c, n in (("volume", "volume"), ("price", "price"), ("tmax_avg", "tmax"),
                     ("ppt_total", "ppt")):
            lag_cols.append(f"lag({c}, {k}) OVER w AS {n}_lag{k}")
    roll_cols = [f"CASE WHEN count({c}) OVER w4 >= {rneed} THEN avg({c}) OVER w4 END AS {c}_roll4_mean"
                 for c in ("volume", "tmax_avg", "ppt_total")]
    lag_sql = ",\n         ".join(lag_cols + roll_cols)
    return f""",
{name}_cells AS ({cells_sql(cfg, series)}),
{name}_agg AS (
  SELECT series, week_ending, sum(volume) AS volume,
         sum(CASE WHEN price IS NOT NULL THEN volume END) AS pv,
         sum(CASE WHEN price IS NOT NULL THEN volume * price END) AS pvp,
         count(*) FILTER (WHERE volume > 0) AS n_districts,
         {wmean('tmax_avg')} AS w_tmax, {wmean('tmin_avg')} AS w_tmin,
         {wmean('ppt_total')} AS w_ppt, {wmean('dd_heat')} AS w_dd_heat,
         {wmean('dd_freeze')} AS w_dd_freeze,
         {wflag('extreme_heat')} AS extreme_heat, {wflag('freeze_risk')} AS freeze_risk,
         {wflag('heavy_rain')} AS heavy_rain
  FROM {name}_cells GROUP BY 1, 2),
{name}_base AS (
  SELECT series, week_ending, volume,
         CASE WHEN pv > 0 THEN pvp / pv END AS price,
         round_even((CASE WHEN volume > 0 THEN (CASE WHEN pv > 0 THEN pv ELSE 0.0 END) / volume
                    ELSE 0.0 END) * 1000.0, 0) / 1000.0 AS coverage,
         n_districts,
         {r2('w_tmax')} AS tmax_avg, {r2('w_tmin')} AS tmin_avg,
         {r2('(w_tmax + w_tmin) / 2')} AS tmean_avg, {r3('w_ppt')} AS ppt_total,
         {r2('w_tmax - w_tmin')} AS diurnal_range,
         extreme_heat, freeze_risk, heavy_rain,
         {r3('w_dd_heat')} AS dd_heat, {r3('w_dd_freeze')} AS dd_freeze
  FROM {name}_agg),
{name} AS (
  SELECT *, year(week_ending) AS year, month(week_ending) AS month,
         weekofyear(week_ending) AS week_of_year,
         CASE WHEN year(week_ending) = {cfg.partial_year} THEN 1 ELSE 0 END AS is_partial_year,
         CASE WHEN price > (CASE WHEN count(price) OVER w8 >= {need} THEN avg(price) OVER w8 END)
                   + {K.SPIKE_SD} * (CASE WHEN count(price) OVER w8 >= {need}
                                      THEN stddev_samp(price) OVER w8 END)
              THEN 1 ELSE 0 END AS price_spike,
         CASE WHEN volume < (CASE WHEN count(volume) OVER w8 >= {need} THEN avg(volume) OVER w8 END)
                   - {K.LOW_SUPPLY_SD} * (CASE WHEN count(volume) OVER w8 >= {need}
                                          THEN stddev_samp(volume) OVER w8 END)
              THEN 1 ELSE 0 END AS low_supply,
         {lag_sql}
  FROM {name}_base
  WINDOW w AS (PARTITION BY series ORDER BY week_ending),
         w8 AS (PARTITION BY series ORDER BY week_ending ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW),
         w4 AS (PARTITION BY series ORDER BY week_ending ROWS BETWEEN {rr - 1} PRECEDING AND CURRENT ROW))"""


def district_cte(cfg: AnalysisConfig = CFG, series=None) -> str:
    series = list(series or [cfg.main_series])
    rr, rneed = K.ROLL_WINDOW
    lag_cols = []
    for k in K.LAGS:
        for c, n in (("volume", "volume"), ("price", "price"), ("tmax_avg", "tmax"),
                     ("ppt_total", "ppt")):
            lag_cols.append(f"lag({c}, {k}) OVER w AS {n}_lag{k}")
    roll_cols = [f"CASE WHEN count({c}) OVER w4 >= {rneed} THEN avg({c}) OVER w4 END AS {c}_roll4_mean"
                 for c in ("volume", "tmax_avg", "ppt_total")]
    az_m = ", ".join(str(m) for m in K.AZ_SEASON_MONTHS)
    ca_m = ", ".join(str(m) for m in K.CA_SEASON_MONTHS)
    return f""",
dist_cells AS ({cells_sql(cfg, series)}),
dist AS (
  SELECT series, week_ending, district, state, volume, price, tmax_avg, tmin_avg, tmax_max,
         tmin_min, ppt_total, ppt_days, tmean_avg, diurnal_range, extreme_heat, freeze_risk,
         heavy_rain, dd_heat, dd_freeze, year, month, week_of_year,
         CASE WHEN year = {cfg.partial_year} THEN 1 ELSE 0 END AS is_partial_year,
         CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END AS has_price,
         {", ".join(lag_cols + roll_cols)},
         CASE WHEN state = 'AZ' AND month IN ({az_m}) THEN 1 ELSE 0 END AS az_season,
         CASE WHEN state = 'CA' AND month IN ({ca_m}) THEN 1 ELSE 0 END AS ca_season,
         CASE WHEN (state = 'AZ' AND month IN ({az_m})) OR (state = 'CA' AND month IN ({ca_m}))
              THEN 1 ELSE 0 END AS peak_season
  FROM dist_cells WHERE district IN {_in(cfg.core_districts)}
  WINDOW w AS (PARTITION BY series, district ORDER BY week_ending),
         w4 AS (PARTITION BY series, district ORDER BY week_ending
                ROWS BETWEEN {rr - 1} PRECEDING AND CURRENT ROW))"""
