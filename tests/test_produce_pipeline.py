"""End to end on literal files in the real feed layout (PRODUCE preset)."""

import datetime as dt
import os

import pytest

from furrow.config import PRODUCE
from furrow.operators import market, panel
from furrow.sources import produce


def _w(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_produce_feeds_to_market(spark, tmp_path):
    d = str(tmp_path)
    # Older shipments: week 2021-01-05 (Tue); Central Arizona merges into Western Arizona.
    _w(f"{d}/old.csv", "Week,Region,Origin,District,Commodity,Volume\n"
       "01/05/2021,Arizona,Yuma,Western Arizona,\"Lettuce, Iceberg\",\"1,000\"\n"
       "01/05/2021,Arizona,Yuma,Central Arizona,\"Lettuce, Iceberg \",500\n"
       "01/05/2021,California,Salinas,Salinas-Watsonville,\"Lettuce, Iceberg\",250\n"
       "01/05/2021,California,Salinas,Salinas-watsonville California,\"Lettuce, Romaine\",200\n")
    # Newer shipments repeat one (week, district, commodity) under the same raw
    # spelling: the newer row wins (dedup runs before spellings are fixed).
    _w(f"{d}/new.csv", "tuesday_week_ending,region,origin,district,commodity,volumes\n"
       "2021-01-05,CALIFORNIA,SALINAS,Salinas-Watsonville,\"Lettuce, Iceberg\",300\n"
       "2021-01-12,ARIZONA,YUMA,Western Arizona,\"Lettuce, Iceberg\",800\n")
    hdr = "report_date,district,commodity,variety,package,item_size,organic,low_price,high_price,mostly_low_price,mostly_high_price\n"
    _w(f"{d}/2021.csv", hdr +
       "01/04/2021,WESTERN ARIZONA,\"Lettuce, Iceberg\",N/A,carton,24s,N,10,12,,\n"           # mid 11
       "01/05/2021,SALINAS-WATSONVILLE CALIFORNIA,\"Lettuce, Iceberg\",N/A,carton,24s,N,18,22,19,21\n"  # 20
       "01/05/2021,SALINAS-WATSONVILLE CALIFORNIA,\"Lettuce, Iceberg\",N/A,carton,24s,Y,40,40,40,40\n"  # organic
       "01/06/2021,WESTERN ARIZONA,Broccoli,N/A,carton,24s,N,1,1,1,1\n")
    _w(f"{d}/extra.csv", hdr +
       "01/04/2021,WESTERN ARIZONA,\"Lettuce, Iceberg\",N/A,carton,24s,N,99,99,99,99\n")     # dup: earlier file wins
    weather = spark.createDataFrame(
        [("yuma_az", dt.date(2021, 1, 4), 20.0, -1.0, 0.0), ("salinas_ca", dt.date(2021, 1, 5), 15.0, 5.0, 30.0)],
        "location string, date date, tmax double, tmin double, ppt double")
    feeds = produce.load_feeds(spark, f"{d}/old.csv", f"{d}/new.csv",
                               [f"{d}/2020.csv", f"{d}/2021.csv", f"{d}/extra.csv"], weather)
    p = {(r["week_ending"], r["district"]): r for r in panel.weekly_panel(feeds, PRODUCE).collect()}
    az = p[(dt.date(2021, 1, 5), "Western Arizona")]
    sal = p[(dt.date(2021, 1, 5), "Salinas-Watsonville")]
    assert az["vol_iceberg"] == 1500.0 and az["price_iceberg"] == pytest.approx(11.0)
    assert az["freeze_risk"] == 1 and az["state"] == "AZ"
    assert sal["vol_iceberg"] == 300.0 and sal["vol_romaine"] == 200.0 and sal["n_commodities"] == 2
    assert sal["price_iceberg"] == pytest.approx(20.0) and sal["heavy_rain"] == 1
    m = {r["week_ending"]: r for r in market.market_series(panel.weekly_panel(feeds, PRODUCE), PRODUCE).collect()}
    w1 = m[dt.date(2021, 1, 5)]
    assert w1["volume"] == 1800.0 and w1["n_districts"] == 2
    assert w1["price"] == pytest.approx((1500 * 11 + 300 * 20) / 1800)
    assert w1["coverage"] == 1.0
    w2 = m[dt.date(2021, 1, 12)]
    assert w2["price"] is None and w2["coverage"] == 0.0 and w2["price_lag1"] == pytest.approx(w1["price"])
