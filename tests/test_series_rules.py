"""Market and window rules on literal fixtures (FIXTURES.md section 2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.config import DRIVER
from furrow.functions.windows import rolling_mean, trailing
from furrow.operators import market

WX = ["tmax_avg", "tmin_avg", "tmax_max", "tmin_min", "ppt_total", "ppt_days", "tmean_avg",
      "diurnal_range", "extreme_heat", "freeze_risk", "heavy_rain", "dd_heat", "dd_freeze"]


def _cells(spark, rows):
    """rows: (week, district, volume, price, tmax)."""
    data = []
    for wk, d, v, p, t in rows:
        data.append(("S", wk, d, v, p, t, t, t, t, 1.0, 1, t, 0.0, 0, 0, 0, 0.0, 0.0))
    schema = ("series string, week_ending date, district string, volume double, price double, "
              "tmax_avg double, tmin_avg double, tmax_max double, tmin_min double, ppt_total double, "
              "ppt_days int, tmean_avg double, diurnal_range double, extreme_heat int, "
              "freeze_risk int, heavy_rain int, dd_heat double, dd_freeze double")
    return spark.createDataFrame(data, schema)


W1 = dt.date(2024, 1, 2)


def test_weighted_price_and_coverage(spark):
    cells = _cells(spark, [(W1, "a", 100.0, 10.0, 20.0), (W1, "b", 300.0, 20.0, 20.0),
                           (W1, "c", 50.0, None, 20.0)])
    r = market._market_aggregate(cells, DRIVER, True).collect()[0]
    assert r["price"] == pytest.approx(17.5)
    assert r["coverage"] == pytest.approx(0.889)
    assert r["volume"] == 450.0 and r["n_districts"] == 3


def test_zero_volume_week(spark):
    cells = _cells(spark, [(W1, "a", 0.0, 10.0, 20.0), (W1, "b", 0.0, None, 20.0)])
    r = market._market_aggregate(cells, DRIVER, True).collect()[0]
    assert r["price"] is None and r["coverage"] == 0.0 and r["n_districts"] == 0
    assert r["tmax_avg"] is None and r["extreme_heat"] == 0


def test_weighted_weather_reference_vs_clean(spark):
    cells = _cells(spark, [(W1, "a", 100.0, 10.0, 20.0), (W1, "b", 100.0, 10.0, None)])
    ref = market._market_aggregate(cells, DRIVER, True).collect()[0]
    clean = market._market_aggregate(cells, DRIVER.with_(weighted_weather_rule="clean"), True).collect()[0]
    assert ref["tmax_avg"] == pytest.approx(10.0)
    assert clean["tmax_avg"] == pytest.approx(20.0)


def test_rolling_guard(spark):
    vals = [1.0, None, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([("S", i, v) for i, v in enumerate(vals)], "series string, t int, x double")
    w = trailing(["series"], "t", 4)
    got = [r["m"] for r in df.select("t", rolling_mean("x", w, 2).alias("m")).orderBy("t").collect()]
    assert got[0] is None and got[1] is None
    assert got[2] == pytest.approx(2.0) and got[3] == pytest.approx(8 / 3) and got[4] == pytest.approx(4.0)


def test_lag_over_gap_counts_rows(spark):
    weeks = [dt.date(2024, 1, 2), dt.date(2024, 1, 9), dt.date(2024, 2, 27)]
    rows = [(w, "ASIA", float(i + 1), 10.0 + i, 20.0) for i, w in enumerate(weeks)]
    cells = _cells(spark, rows).withColumn("state", F.lit("CA")) \
        .withColumn("year", F.year("week_ending")).withColumn("month", F.month("week_ending")) \
        .withColumn("week_of_year", F.weekofyear("week_ending"))
    wide = cells.select("week_ending", "district", "state", "year", "month", "week_of_year", *WX,
                        F.col("volume").alias("vol_promo"), F.col("price").alias("price_promo"))
    cfg = DRIVER.with_(core_districts=("ASIA",))
    out = market.district_series(wide, cfg, ["PROMO"]).orderBy("week_ending").collect()
    assert out[2]["volume_lag1"] == 2.0 and out[2]["price_lag1"] == 11.0


def test_price_zero_is_missing(spark):
    cells = _cells(spark, [(W1, "a", 100.0, 0.0, 20.0)])
    wide = cells.select("week_ending", "district", *WX, F.lit("CA").alias("state"),
                        F.lit(2024).alias("year"), F.lit(1).alias("month"), F.lit(1).alias("week_of_year"),
                        F.col("volume").alias("vol_promo"), F.col("price").alias("price_promo"))
    c = market.panel_cells(wide, DRIVER, ["PROMO"]).collect()[0]
    assert c["price"] is None and c["volume"] == 100.0
