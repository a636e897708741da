"""Updates of stored results: upserting stream, name register, incremental panel and series;
bucketed tables, many files, medians whose interval missed, scalers, trees."""

import datetime as dt
import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import DRIVER as CFG
from furrow.functions.aggregates import exact_median
from furrow.functions.columns import title_case
from furrow.operators import backtest as B
from furrow.operators import incremental as INC
from furrow.operators import market, panel
from furrow.operators import sequences as SQ
from furrow.operators import trees as TR
from furrow.plans.q_panel import build_panel, feeds
from furrow.sources import feeds as FD
from furrow.sources.names import read_register, register_names
from furrow.streaming import weather as SW

SF = "/root/testdata/sf0.001"
READINGS = "location string, date date, tmax double, tmin double, ppt double, revision long"


def _weeks(df):
    return {(r["week_ending"], r["district"]): tuple(r) for r in df.orderBy("week_ending", "district").collect()}


def test_stream_upserts_equal_batch_upserts_in_any_arrival_order(spark, tmp_path):
    rnd = random.Random(4)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    right = {(s, day(i)): (rnd.uniform(-5, 45), rnd.uniform(-8, 20), rnd.choice([None, 0.0, 3.0])) for s in ("a", "b") for i in range(30)}
    first = [(s, d, 99.0, -99.0, 50.0, 0) for (s, d) in right if d.day % 3 == 0] + [(s, d, *v, 0) for (s, d), v in right.items() if d.day % 3]
    fix = [(s, d, *right[s, d], 1) for (s, d) in right if d.day % 3 == 0]
    again = [r for r in first if r[1].day % 3 == 1]
    lm = spark.createDataFrame([("a", "D1"), ("b", "D1")], "location string, district string")
    want = _weeks(panel.weather_weekly(spark.createDataFrame([(s, d, *v) for (s, d), v in right.items()], READINGS.rsplit(",", 1)[0]), lm))
    for k, order in enumerate(itertools.permutations([first, fix, again + again])):
        if k % 2:           # three of the six orders
            continue
        src, out, chk = (str(tmp_path / f"{n}{k}") for n in ("src", "out", "chk"))
        for rows in order:
            spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(src)
            SW.run_upserted_weather(spark, src, out, chk)
        got = _weeks(SW.upserted_weeks(spark, out, lm))
        assert got.keys() == want.keys()
        for w in want:
            assert got[w] == pytest.approx(want[w])
    # One reading landed twice counts once; a correction of equal revision replaces it.
    src, out, chk = (str(tmp_path / f"{n}one") for n in ("src", "out", "chk"))
    for value in (4.0, 4.0, 7.0):
        spark.createDataFrame([("a", day(1), 1.0, 0.0, value, None)], READINGS).coalesce(1).write.mode("append").parquet(src)
        SW.run_upserted_weather(spark, src, out, chk)
        row = SW.upserted_weeks(spark, out, lm).collect()[0]
        assert (row["ppt_total"], row["n_weather_days"]) == (value, 1)


def test_register_keeps_order_and_fails_loudly(spark, tmp_path):
    path = str(tmp_path / "names")
    df = lambda names: spark.createDataFrame([(n,) for n in names], "c string")
    assert read_register(spark, path) == []
    assert register_names(df(["b", "d", None, "b"]), "c", path) == ["b", "d"]
    assert register_names(df(["c", "a", "d"]), "c", path) == ["b", "d", "a", "c"]
    assert register_names(df(["c"]), "c", path) == ["b", "d", "a", "c"] == read_register(spark, path)
    with pytest.raises(ValueError, match="more than 5"):
        register_names(df(["e", "f"]), "c", path, limit=5)
    assert read_register(spark, path) == ["b", "d", "a", "c"]
    assert register_names(df([]), "c", str(tmp_path / "none")) == []


def test_found_names_give_columns_also_for_equal_suffixes(spark):
    rows = [(dt.date(2024, 1, 2), "D", "Lettuce, Green Leaf", 2.0), (dt.date(2024, 1, 2), "D", "Lettuce,  Green  leaf", 4.0),
            (dt.date(2024, 1, 2), "D", "Kale", 7.0)]
    points = spark.createDataFrame(rows, "week_ending date, district string, commodity string, fob_price double")
    r = panel.prices_weekly(points, K.PRODUCE, ["Lettuce, Green Leaf", "Kale", "Gone"]).collect()[0]
    assert (r["price_green_leaf"], r["price_kale"], r["price_gone"], r["n_price_obs"]) == (2.0, 7.0, None, 3)


def test_affected_weeks_reach_lags_and_windows(spark):
    weeks = [dt.date(2024, 1, 2) + dt.timedelta(weeks=i) for i in range(40)]
    line = lambda ws: spark.createDataFrame([(w,) for w in ws], "week_ending date")
    got = {r["week_ending"]: r["affected"] for r in INC.affected_weeks(line(weeks), line([weeks[20]])).collect()}
    assert {w for w, a in got.items() if a} == set(weeks[20:28]) and {w for w, a in got.items() if not a} == set(weeks[13:20])
    # A withdrawn week moves the rows after it.
    got = {r["week_ending"]: r["affected"] for r in INC.affected_weeks(line(weeks[:20] + weeks[21:]), line([weeks[20]])).collect()}
    assert {w for w, a in got.items() if a} == set(weeks[21:29])
    assert INC.affected_weeks(line(weeks), line([dt.date(2030, 1, 1)])).where("affected = 1").count() == 0


def test_updated_series_equals_a_full_run(spark):
    f = feeds(spark, SF)
    full = INC.materialize(build_panel(spark, SF))
    weeks = sorted(r[0] for r in full.select("week_ending").distinct().collect())
    picked = [weeks[10], weeks[11], weeks[40], weeks[-1]]
    gone = F.col("week_ending").isin(picked) & ((F.col("week_ending") == picked[0]) | (F.col("district").endswith("3")))
    first = f | {"shipments": f["shipments"].where(~gone)}
    before = INC.materialize(panel.weekly_panel(first, CFG))
    stored = INC.materialize(market.market_series(before, CFG))
    changed = INC.changed_keys(shipments=f["shipments"].where(gone), shipment_map=f["shipment_map"])
    now = INC.materialize(INC.update_panel(before, f, changed, CFG))
    key = lambda r: (r["week_ending"], r["district"])
    got, want = ({key(r): r.asDict() for r in d.collect()} for d in (now, full))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], nan_ok=True)
    series = {r["week_ending"]: r.asDict() for r in INC.update_market(stored, now, changed, CFG).collect()}
    direct = {r["week_ending"]: r.asDict() for r in market.market_series(full, CFG).collect()}
    assert series.keys() == direct.keys()
    for k in direct:
        assert series[k] == pytest.approx(direct[k], nan_ok=True), k


def test_bucketed_tables_join_without_a_shuffle_and_are_sorted(spark, tmp_path):
    run = uuid.uuid4().hex
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        week = lambda i: dt.date(2020, 1, 7) + dt.timedelta(weeks=i % 50)
        parts = []
        for name in ("ship", "price", "wx"):
            df = spark.createDataFrame([(week(i), f"d{i // 50}", float(i)) for i in range(200)], f"week_ending date, district string, {name} double")
            parts.append(FD.write_bucketed(df, f"{name}_{run}", str(tmp_path / name), panel.KEY, 4))
        out = panel.join_panel(*parts, CFG)
        assert out.count() == 200
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("Initial Plan")[0].replace("BroadcastExchange", "")
        for file in (tmp_path / "ship").glob("*.parquet"):
            rows = [tuple(r) for r in spark.read.parquet(str(file)).select(*panel.KEY).collect()]
            assert rows == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_price_files_are_a_few_scans(spark, tmp_path):
    paths = []
    for i in range(120):
        short = i % 5 == 0
        head = "report_date,district,commodity,low_price,high_price" + ("" if short else ",variety")
        row = f"01/{i % 28 + 1:02d}/2020,D1,Lettuce x,{i},{i + 1}" + ("" if short else f",v{i % 7}")
        path = tmp_path / f"file {i}.csv"
        path.write_text(f"{head}\n{row}\n")
        paths.append(str(path))
    paths.insert(3, str(tmp_path / "missing.csv"))
    df = FD.read_prices(spark, paths, keep_districts=["D1"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("RelationV2") <= 2
    want = {}
    for rank, path in enumerate(paths):
        if "missing" in path:
            continue
        i = int(path.split("file ")[1][:-4])
        key = (i % 28 + 1, "N/A" if i % 5 == 0 else f"v{i % 7}")
        want.setdefault(key, (rank, str(i)))
    got = {(r["report_date"].day, r["variety"]): (r["file_rank"], r["low_price"]) for r in df.collect()}
    assert got == want


@pytest.mark.parametrize("margin", [None, -0.2, 0.001])
def test_median_is_exact_also_where_the_interval_missed(spark, margin):
    rng = np.random.default_rng(7)
    rows = [(g, float(v)) for g, n in (("a", 1001), ("b", 400), ("c", 1), ("d", 2)) for v in rng.integers(0, 300, n)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v", margin=margin, accuracy=50 if margin else 1000).collect()}
    assert got == {g: np.median([v for k, v in rows if k == g]) for g in "abcd"}


def test_scalers_at_large_offsets(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, 120) + 1e8
    rows = [("S", 2000 + i // 20, float(x), 7.3) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "series string, year int, x double, c double")
    folds = spark.createDataFrame([("S", 2004), ("S", 2005)], "series string, fold int")
    got = {(r["fold"], r["feature"]): r for r in SQ.fold_scalers(df, ["series"], ["x", "c"], folds).collect()}
    for fold in (2004, 2005):
        own = v[:(fold - 2000) * 20]
        assert got[fold, "x"]["std"] == pytest.approx(own.std(), rel=1e-7) and got[fold, "x"]["n"] == len(own)
        assert got[fold, "c"]["std"] == 0.0 and got[fold, "c"]["mean"] == pytest.approx(7.3)


def test_title_case_of_any_run_of_letters(spark):
    names = ["SALINAS-WATSONVILLE", "o'brien's (north/SOUTH) valley", "été  à l'ÉCOLE", "", "x1y2"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(title_case("s")).collect()]
    assert got == [n.title() for n in names]


def test_trees_find_a_planted_signal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = 3 * (x[:, 2] > 0.3) + 0.01 * x[:, 0]
    df = spark.createDataFrame([(dt.date(2000, 1, 4) + dt.timedelta(weeks=i), *map(float, x[i]), float(y[i])) for i in range(600)],
                               "week_ending date, x0 double, x1 double, x2 double, x3 double, price double")
    features = ("x0", "x1", "x2", "x3")
    for method, params in (("forest", K.FOREST), ("boost", K.BOOST_CONSERVATIVE)):
        spec = B.ModelSpec(method, features, "price", method, params=tuple(sorted(params.items())))
        model = TR.fit_model(TR.dealt(df), spec, scale=0.05)
        importance = model.featureImportances.toArray()
        assert importance.sum() == pytest.approx(1.0) and importance.argmax() == 2 and importance[2] > 0.8
    assert TR.dealt(df).rdd.getNumPartitions() == 2
