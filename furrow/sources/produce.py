"""Real produce feeds -> the inputs of ``operators.panel.weekly_panel``.

Shipments come as an older positional CSV and a newer named CSV, prices as
yearly report files plus extras (precedence order), weather as a daily table
(location, date, tmax, tmin, ppt) — e.g. the output of ``feeds.weather_wide``.
The district maps are the fixed tables of ``config``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from furrow import config as K
from furrow.functions.aggregates import literal_table
from furrow.sources import feeds as FD


def load_feeds(spark: SparkSession, old_shipments: str | Sequence[str],
               new_shipments: str | Sequence[str], price_files: Sequence[str],
               weather: DataFrame) -> dict[str, DataFrame]:
    """Read, clean and deduplicate the three feeds; attach the district maps."""
    ship = FD.merge_shipments(spark, [FD.read_shipments_positional(spark, old_shipments, 0),
                                      FD.read_shipments_named(spark, new_shipments, 1)])
    prices = FD.read_prices(spark, list(price_files))
    locations = FD.location_table(spark)
    return {
        "shipments": ship,
        "prices": prices,
        "weather": weather,
        "shipment_map": literal_table(spark, K.SHIPMENT_DISTRICT_MAP, "raw string, std string"),
        "price_map": literal_table(spark, K.PRICE_DISTRICT_MAP, "raw string, std string"),
        "location_map": locations.select("location", "district"),
    }
