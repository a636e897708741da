"""Weekly weather rules and the streaming aggregate (backfill, idempotent batches)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from furrow.operators import panel
from furrow.streaming import weather as SW

LOC = [("st", "D1")]


def _daily(spark, rows):
    return spark.createDataFrame(rows, "location string, date date, tmax double, tmin double, ppt double")


def test_all_missing_rain_week(spark):
    days = [dt.date(2024, 1, 3) + dt.timedelta(days=i) for i in range(7)]  # Wed..Tue
    d = _daily(spark, [("st", x, 20.0, 5.0, None) for x in days])
    lm = spark.createDataFrame(LOC, "location string, district string")
    r = panel.weather_weekly(d, lm).collect()
    assert len(r) == 1 and r[0]["week_ending"] == dt.date(2024, 1, 9)
    assert r[0]["ppt_total"] == 0.0 and r[0]["heavy_rain"] == 0 and r[0]["ppt_days"] == 0
    assert r[0]["n_weather_days"] == 7


def test_unmapped_location_dropped_and_flags(spark):
    d = _daily(spark, [("st", dt.date(2024, 1, 9), 41.0, -1.0, 30.0),
                       ("nowhere", dt.date(2024, 1, 9), 10.0, 5.0, 1.0)])
    lm = spark.createDataFrame(LOC, "location string, district string")
    r = panel.weather_weekly(d, lm).collect()
    assert len(r) == 1
    assert (r[0]["extreme_heat"], r[0]["freeze_risk"], r[0]["heavy_rain"]) == (1, 1, 1)
    assert r[0]["dd_heat"] == pytest.approx(1.0) and r[0]["dd_freeze"] == pytest.approx(1.0)


def test_stream_matches_batch_for_late_rows_and_a_backfilled_station(spark, tmp_path):
    lm = spark.createDataFrame([*LOC, ("new", "D2")], "location string, district string")
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    first = [("st", dt.date(2024, 1, 3) + dt.timedelta(days=i), 20.0 + i, 5.0, 1.0) for i in range(70)]
    _daily(spark, first).coalesce(1).write.mode("append").parquet(src)
    SW.run_weekly_weather(spark, src, lm, out, chk, files_per_batch=1)
    # One more day of an open week, a reading nine weeks late, and another station's history.
    late = [("st", dt.date(2024, 3, 13), 30.0, 6.0, 2.0), ("st", dt.date(2024, 1, 3), -50.0, -50.0, 99.0)]
    history = [("new", dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i, 1.0, 0.5) for i in range(60)]
    _daily(spark, late).coalesce(1).write.mode("append").parquet(src)
    _daily(spark, history).coalesce(1).write.mode("append").parquet(src)
    SW.run_weekly_weather(spark, src, lm, out, chk, files_per_batch=1)
    key = lambda r: (r["week_ending"], r["district"])
    got = {key(r): r for r in SW.latest_weeks(spark, out).collect()}
    expect = {key(r): r for r in panel.weather_weekly(_daily(spark, first + late + history), lm).collect()}
    assert set(got) == set(expect)
    for k, r in expect.items():
        assert got[k]["tmax_avg"] == pytest.approx(r["tmax_avg"]) and got[k]["ppt_total"] == pytest.approx(r["ppt_total"])
    assert got[(dt.date(2024, 1, 9), "D1")]["tmin_min"] == -50.0
    # Re-running finds nothing new (checkpointed offsets), output unchanged.
    SW.run_weekly_weather(spark, src, lm, out, chk, files_per_batch=1)
    assert SW.compact_weeks(spark, out, str(tmp_path / "table")).count() == len(expect)
