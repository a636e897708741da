"""Command line: run the analysis on feed files or on the test tables.

    python -m furrow --test-tables /root/testdata/sf0.01 --out /shared/results
    python -m furrow --old-shipments old.csv --new-shipments new.csv \\
        --prices 2010.csv 2011.csv ... --weather weather_daily.parquet --out /shared/results

The session comes from the environment (spark-submit settings); on a
cluster ``spark.checkpoint.dir`` must name a shared folder.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from furrow import config as K
from furrow.pipeline import FAST_STAGES, STAGES, run


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="furrow")
    ap.add_argument("--out", required=True, help="output folder (shared storage)")
    ap.add_argument("--test-tables", help="folder with the TPC-H-style test tables")
    ap.add_argument("--old-shipments")
    ap.add_argument("--new-shipments")
    ap.add_argument("--prices", nargs="*", default=[], help="price files in precedence order")
    ap.add_argument("--weather", help="daily weather table (location, date, tmax, tmin, ppt)")
    ap.add_argument("--stages", nargs="*", default=list(FAST_STAGES), choices=list(STAGES))
    ap.add_argument("--trees", action="store_true", help="add boosted trees and forests")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("furrow").getOrCreate()
    if a.test_tables:
        from furrow.sources import testmap
        feeds, cfg = testmap.feeds(spark, a.test_tables), K.DRIVER
    else:
        from furrow.sources import produce
        weather = spark.read.parquet(a.weather)
        feeds = produce.load_feeds(spark, a.old_shipments, a.new_shipments, a.prices, weather)
        cfg = K.PRODUCE
    print(json.dumps(run(spark, feeds, cfg, a.out, a.stages, a.trees), indent=1))


if __name__ == "__main__":
    main()
