"""Incremental panel and market series.

A late or corrected week changes one (week, district) row of the panel, the week's
row of every market series, and the rows after it that lags and trailing windows
reach. ``changed_keys`` finds the keys that new feed rows touch; ``update_panel``
rebuilds those panel rows only; ``affected_weeks`` propagates the weeks along the
rows of the series; ``update_market`` recomputes the affected rows from the few
weeks they look back on. All other rows are kept as stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import AnalysisConfig
from furrow.functions.columns import week_ending_tuesday
from furrow.operators import market, panel
from furrow.session import materialize

KEY = panel.KEY
#: Rows that a row looks back on: its longest lag, or its longest window less itself.
REACH = max([*K.LAGS, K.LABEL_WINDOW[0] - 1, K.ROLL_WINDOW[0] - 1])


def changed_keys(shipments: DataFrame | None = None, prices: DataFrame | None = None, weather: DataFrame | None = None,
                 shipment_map: DataFrame | None = None, price_map: DataFrame | None = None,
                 location_map: DataFrame | None = None) -> DataFrame:
    """(week_ending, district) keys that the given new or withdrawn feed rows touch."""
    found = []
    if shipments is not None:
        found.append(panel._map_district(shipments.select("week_ending", "district"), shipment_map))
    if prices is not None:
        found.append(panel._map_district(prices.select(week_ending_tuesday("report_date").alias("week_ending"), "district"), price_map))
    if weather is not None:
        places = location_map.select("location", "district")
        found.append(weather.select(week_ending_tuesday("date").alias("week_ending"), "location")
                     .join(places, "location").select("week_ending", "district"))
    out = found[0].select(*KEY)
    for f in found[1:]:
        out = out.unionByName(f.select(*KEY))
    return out.where(F.col("week_ending").isNotNull() & F.col("district").isNotNull()).distinct()


def update_panel(stored: DataFrame, feeds: dict[str, DataFrame], changed: DataFrame, cfg: AnalysisConfig,
                 price_names: Sequence[str] | None = None) -> DataFrame:
    """``stored`` with the rows of ``changed`` keys rebuilt from the feeds' rows of those weeks
    (rows whose shipments are gone leave the panel)."""
    weeks = changed.select(F.col("week_ending").alias("_week")).distinct()

    def near(feed: str, week):
        return feeds[feed].join(weeks, week == F.col("_week"), "left_semi")

    recent = feeds | {"shipments": near("shipments", F.col("week_ending")),
                      "prices": near("prices", week_ending_tuesday("report_date")),
                      "weather": near("weather", week_ending_tuesday("date"))}
    rebuilt = panel.weekly_panel(recent, cfg, price_names).join(changed, KEY, "left_semi")
    return stored.join(changed, KEY, "left_anti").unionByName(rebuilt, allowMissingColumns=True)


def affected_weeks(weeks: DataFrame, changed: DataFrame, reach: int = REACH) -> DataFrame:
    """(week_ending, affected): of ``weeks`` (all weeks of the series) those at a changed week
    or up to ``reach`` rows after one (affected 1), and those that an affected row looks back
    on (0). A changed week that left the series moves the rows after it, so it counts too.

    The window runs over weeks (thousands at most), not over rows of the feeds."""
    gone = changed.select("week_ending").distinct().withColumn("_hit", F.lit(1))
    line = weeks.select("week_ending").distinct().withColumn("_in", F.lit(1)).join(gone, "week_ending", "full")
    order = Window.orderBy("week_ending")
    # A withdrawn week is no row: its hit moves on to the next row of the series.
    row = F.sum(F.coalesce("_in", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("_row", F.coalesce(row, F.lit(0)))
    line = line.groupBy("_row").agg(F.max(F.when(F.col("_in") == 1, F.col("week_ending"))).alias("week_ending"),
                                    F.coalesce(F.max("_hit"), F.lit(0)).alias("_hit"))
    by_row = Window.orderBy("_row")
    line = line.withColumn("affected", F.max("_hit").over(by_row.rowsBetween(-reach, 0)))
    line = line.withColumn("_needed", F.max("affected").over(by_row.rowsBetween(0, reach)))
    return line.where((F.col("_needed") == 1) & F.col("week_ending").isNotNull()).select("week_ending", "affected")


def update_market(stored: DataFrame, updated_panel: DataFrame, changed: DataFrame, cfg: AnalysisConfig,
                  series: Sequence[str] | None = None, round_all: bool = True) -> DataFrame:
    """``stored`` market series with the affected rows recomputed from ``updated_panel``."""
    near = affected_weeks(updated_panel, changed)
    part = updated_panel.join(near.select("week_ending"), "week_ending", "left_semi")
    again = market.market_series(part, cfg, series, round_all)
    again = again.join(near.where("affected = 1").select("week_ending"), "week_ending", "left_semi")
    touched = near.where("affected = 1").select("week_ending").unionByName(changed.select("week_ending")).distinct()
    return stored.join(touched, "week_ending", "left_anti").unionByName(again)


def rewrite_years(updated: DataFrame, weeks: DataFrame, path: str) -> DataFrame:
    """Write ``updated`` over the table at ``path`` (partitioned by year), only the years of
    ``weeks``; other years' files stay as they are. Returns the table."""
    years = weeks.select(F.year("week_ending").alias("year")).distinct()
    rows = materialize(updated.join(years, "year", "left_semi"))       # it was read from the files it replaces
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    return updated.sparkSession.read.parquet(path)
