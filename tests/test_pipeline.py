"""The whole run on the smallest test tables writes every result table."""

import os

import pytest

from furrow.config import DRIVER
from furrow.pipeline import FAST_STAGES, run
from furrow.sources import testmap

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_pipeline_writes_all_tables(spark, tmp_path):
    out = run(spark, testmap.feeds(spark, SF), DRIVER, str(tmp_path), FAST_STAGES)
    for name in ("weekly_panel", "market_series", "leaderboard", "error_by_coverage",
                 "district_fit", "volume_leaderboard", "variety_fit", "volume_fit", "coverage_by_district",
                 "seasonal_profile", "event_shares", "volatile_years", "summary_statistics", "shipment_profile", "price_profile",
                 "price_rows_by_year", "early_late_change", "extreme_weather_specs", "error_by_coverage3",
                 "transition_split"):
        assert name in out and spark.read.parquet(out[name]).count() > 0, name
    assert {"weather_missing_days", "period_coefficients"} <= set(out)
    # The panel table is partitioned by year.
    assert any(d.startswith("year=") for d in os.listdir(out["weekly_panel"]))


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_command_line(spark, tmp_path, capsys):
    import json
    from furrow.__main__ import main
    main(["--test-tables", SF, "--out", str(tmp_path), "--stages", "panel", "series"])
    written = json.loads(capsys.readouterr().out)
    assert {"weekly_panel", "market_series", "district_series"} <= set(written)
