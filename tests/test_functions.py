"""Scalar rules on literal fixtures (FIXTURES.md section 2)."""

import datetime as dt

from pyspark.sql import functions as F

from furrow.functions.columns import (
    bin_label, degree_days_above, degree_days_below, midpoint_with_fallback, parse_date_mixed,
    parse_date_us, parse_number, title_case, week_ending_tuesday,
)
from furrow import config as K


def test_comma_and_bad_numbers(spark):
    df = spark.createDataFrame([("1,234",), ("x",), ("",), ("NaN",), (" 12.5 ",)], "v string")
    got = [r[0] for r in df.select(parse_number("v")).collect()]
    assert got == [1234.0, None, None, None, 12.5]


def test_fixed_date_parse_drops_bad(spark):
    df = spark.createDataFrame([("01/31/2020",), ("13/45/2020",), ("1/5/2021",)], "d string")
    got = [r[0] for r in df.select(parse_date_us("d")).collect()]
    assert got == [dt.date(2020, 1, 31), None, dt.date(2021, 1, 5)]


def test_mixed_date_parse(spark):
    df = spark.createDataFrame([("2020-03-03",), ("3/10/2020",), ("garbage",)], "d string")
    got = [r[0] for r in df.select(parse_date_mixed("d")).collect()]
    assert got == [dt.date(2020, 3, 3), dt.date(2020, 3, 10), None]


def test_week_bucket_tuesday(spark):
    # 2024-12-31 is a Tuesday.
    days = [dt.date(2024, 12, 31), dt.date(2025, 1, 1), dt.date(2024, 12, 30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(week_ending_tuesday("d")).collect()]
    assert got == [dt.date(2024, 12, 31), dt.date(2025, 1, 7), dt.date(2024, 12, 31)]


def test_week_bucket_matches_rule_over_many_days(spark):
    df = spark.range(0, 3000).select(F.date_add(F.lit(dt.date(2010, 1, 1)), F.col("id").cast("int")).alias("d"))
    rows = df.select("d", week_ending_tuesday("d").alias("w")).collect()
    for d, w in rows:
        assert w.weekday() == 1 and 0 <= (w - d).days <= 6


def test_iso_week_vs_calendar_year(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2020, 12, 29),)], "d date")
    got = df.select(F.weekofyear("d"), F.year("d")).collect()
    assert [tuple(r) for r in got] == [(53, 2021), (53, 2020)]


def test_midpoint_fallback(spark):
    rows = [("10", "12", "8", "9"), ("10", "", "8", "9"), ("", "", "8", ""), ("x", "12", "7", "9")]
    df = spark.createDataFrame(rows, "ml string, mh string, lo string, hi string")
    got = [r[0] for r in df.select(midpoint_with_fallback("ml", "mh", "lo", "hi")).collect()]
    assert got == [11.0, 8.5, None, 8.0]


def test_title_case_after_hyphen(spark):
    df = spark.createDataFrame([("SALINAS-WATSONVILLE",), ("imperial valley",)], "s string")
    got = [r[0] for r in df.select(title_case("s")).collect()]
    assert got == ["Salinas-Watsonville", "Imperial Valley"]


def test_degree_days_keep_missing(spark):
    df = spark.createDataFrame([(45.0, -2.0), (None, None), (30.0, 5.0)], "tmax double, tmin double")
    got = df.select(degree_days_above("tmax", 40.0), degree_days_below("tmin", 0.0)).collect()
    assert [tuple(r) for r in got] == [(5.0, 2.0), (None, None), (0.0, 0.0)]


def test_coverage_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.7,), (1.0,)], "c double")
    got = [r[0] for r in df.select(bin_label("c", K.COVERAGE_BINS)).collect()]
    assert got == ["Very low (<0.5)", "Low (0.5-0.7)", "Medium (0.7-0.85)", "Very high (>0.95)"]
    # The figure's (lo, hi] edges drop coverage 0.
    got2 = [r[0] for r in df.select(bin_label("c", K.COVERAGE_BINS, closed="right")).collect()]
    assert got2[0] is None and got2[1] == "Very low (<0.5)"


def test_round_half_even_like_numpy(spark):
    import numpy as np
    from furrow.functions.columns import round_half_even
    vals = [2.175, 0.0625, 2.5, 0.125, 1.005, -0.0625, 17.4999]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got2 = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    got3 = [r[0] for r in df.select(round_half_even("x", 3)).collect()]
    assert got2 == [float(np.round(v, 2)) for v in vals]
    assert got3 == [float(np.round(v, 3)) for v in vals]


def test_exact_median_hot_group_matches_numpy(spark):
    import numpy as np
    from furrow.functions.aggregates import exact_median
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.integers(0, 5000, 20001)]        # one huge group
    rows += [("even", float(v)) for v in (1, 2, 3, 10)]                    # even count
    rows += [("dup", 5.0)] * 7 + [("one", 3.5)]                            # ties, single value
    rows += [("hot2", float(v)) for v in rng.normal(0, 1, 4000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "v", "m").collect()}
    for k in {r[0] for r in rows}:
        vals = np.array([v for kk, v in rows if kk == k])
        assert got[k] == float(np.median(vals)), k


def test_tree_backtest_without_folds_is_empty(spark):
    from furrow.operators import backtest as B
    from furrow.operators import trees as TR
    rows = [("S", 2000 + (i % 3), float(i), float(i % 7), float(i) * 2) for i in range(60)]
    df = spark.createDataFrame(rows, "series string, year int, x1 double, x2 double, price double") \
        .withColumn("week_ending", F.lit(None).cast("date")).withColumn("coverage", F.lit(1.0))
    spec = B.ModelSpec("b", ("x1", "x2"), "price", "boost", params=tuple(sorted(
        dict(trees=5, depth=2, step=0.1, rows=1.0, cols=1.0, min_leaf=1).items())))
    out = TR.tree_backtest(spark, df, [spec])
    assert out.count() == 0 and "pred_level" in out.columns


def test_name_normalisation():
    from furrow.config import PRODUCE, commodity_suffix
    from furrow.operators.impute import dummy_name
    assert commodity_suffix("Lettuce, Green Leaf", "Lettuce, ") == "green_leaf"
    assert [PRODUCE.suffix(c) for c in PRODUCE.commodities] == [
        "iceberg", "romaine", "green_leaf", "red_leaf", "boston"]
    assert dummy_name("Salinas-Watsonville") == "d_salinas_watsonville"
    assert dummy_name("Western Arizona") == "d_western_arizona"
