"""CSV / JSON ingest, dedup rules and the upsert on literal files."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from furrow.operators.dedup import keep_first, keep_last, shipment_order
from furrow.sources import feeds


def _write(path, text, bom=False):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write(text)


def test_positional_shipments_with_bom_and_extra_columns(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "old.csv")
    _write(p, "Week Ending,Region,Origin,District,Commodity,Volume,Extra\n"
              "01/05/2010,California,Salinas,Salinas Valley California,\"Lettuce, Iceberg \",\"1,234\",zz\n"
              "2010-01-12,California,Salinas,Oxnard District,\"Lettuce, Romaine\",99,zz\n"
              "bad,California,Salinas,Oxnard District,\"Lettuce, Romaine\",x,zz\n", bom=True)
    df = feeds.read_shipments_positional(spark, p)
    rows = df.orderBy("row_seq").collect()
    assert rows[0]["week_ending"] == dt.date(2010, 1, 5) and rows[0]["volumes"] == 1234.0
    assert rows[0]["commodity"] == "Lettuce, Iceberg "  # trimmed later, after dedup
    assert rows[1]["week_ending"] == dt.date(2010, 1, 12) and rows[1]["volumes"] == 99.0
    assert rows[2]["week_ending"] is None and rows[2]["volumes"] is None


def test_named_shipments_title_case(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "new.csv")
    _write(p, "tuesday_week_ending,region,origin,district,commodity,volumes\n"
              "2022-01-04,CALIFORNIA,SALINAS-WATSONVILLE,Salinas-Watsonville,Lettuce Iceberg,12\n")
    r = feeds.read_shipments_named(spark, p).collect()[0]
    assert r["region"] == "California" and r["origin"] == "Salinas-Watsonville"
    assert r["volumes"] == 12.0 and r["week_ending"] == dt.date(2022, 1, 4)


def test_dedup_last_region_rule(spark):
    w = dt.date(2020, 1, 7)
    rows = [(w, "A region", "o", "D", "C", 1.0, 0, 0),
            (w, "B region", "o", "D", "C", 2.0, 0, 1),
            (w, None, "o", "D", "C", 3.0, 0, 2),
            (w, "A region", "o", "D", "C2", 4.0, 0, 3),
            (w, "B region", "o", "D", "C2", 5.0, 0, 4)]
    df = spark.createDataFrame(rows, "week_ending date, region string, origin string, district string, "
                                     "commodity string, volumes double, source_rank int, row_seq long")
    out = {r["commodity"]: r["volumes"]
           for r in keep_last(df, ["week_ending", "district", "commodity"], shipment_order()).collect()}
    assert out == {"C": 3.0, "C2": 5.0}  # missing region beats both; else greatest region


def test_dedup_first_file_order(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "2019.csv")
    b = os.path.join(tmpdir_path, "extra.csv")
    hdr = "report_date,district,commodity,variety,package,item_size,organic,low_price,high_price\n"
    _write(a, hdr + "01/08/2019,WESTERN ARIZONA,Lettuce, Iceberg,N/A,carton,24s,N,10,12\n".replace(
        "Lettuce, Iceberg", "\"Lettuce, Iceberg\""))
    _write(b, hdr + "01/08/2019,WESTERN ARIZONA,\"Lettuce, Iceberg\",N/A,carton,24s,N,20,22\n"
                    "13/45/2019,WESTERN ARIZONA,\"Lettuce, Iceberg\",N/A,carton,24s,N,1,1\n"
                    "01/09/2019,SOMEWHERE ELSE,\"Lettuce, Iceberg\",N/A,carton,24s,N,1,1\n"
                    "01/09/2019,WESTERN ARIZONA,Broccoli,N/A,carton,24s,N,1,1\n")
    missing = os.path.join(tmpdir_path, "2018.csv")
    df = feeds.read_prices(spark, [missing, a, b])
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["low_price"] == "10"
    # Absent columns take their defaults.
    assert rows[0]["mostly_low_price"] == "" and rows[0]["market_tone_comments"] == ""


def test_keep_first_deterministic_across_partitions(spark):
    rows = [(i % 50, i, float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, seq long, v double")
    a = sorted(tuple(r) for r in keep_first(df.repartition(3), ["k"], [F.col("seq")]).collect())
    b = sorted(tuple(r) for r in keep_first(df.repartition(11), ["k"], [F.col("seq")]).collect())
    assert a == b and all(r[1] == r[0] for r in a)


def test_payload_to_daily_and_wide(spark):
    pay = [("yuma_az", "tmax", "2020-01-30",
            json.dumps({"result": {"data": {"tmax": [20.0, 21.5, 19.0]}}, "errors": None})),
           ("yuma_az", "tmin", "2020-01-30",
            json.dumps({"result": {"data": {"tmin": [5.0, 6.0, 4.0]}}, "errors": None})),
           ("yuma_az", "ppt", "2020-01-30", json.dumps({"result": {"data": {}}, "errors": "timeout"}))]
    p = spark.createDataFrame(pay, "location string, variable string, start_date string, payload string")
    daily = feeds.daily_from_payload(p)
    assert daily.count() == 6
    wide = feeds.weather_wide(daily, feeds.location_table(spark)).orderBy("date").collect()
    assert [r["date"] for r in wide] == [dt.date(2020, 1, 30), dt.date(2020, 1, 31), dt.date(2020, 2, 1)]
    assert wide[1]["tmax"] == 21.5 and wide[1]["ppt"] is None and wide[1]["district"] == "Western Arizona"
    assert feeds.payload_errors(p).count() == 1


def test_date_chunks_keep_last_day(spark):
    c = feeds.date_chunks(spark, "2020-01-01", "2021-01-01", 365).orderBy("chunk_start").collect()
    assert c[0]["chunk_end"] == dt.date(2020, 12, 30)
    assert c[-1]["chunk_start"] == dt.date(2020, 12, 31) and c[-1]["chunk_end"] == dt.date(2021, 1, 1)


def test_upsert_no_duplicate_days(spark):
    old = spark.createDataFrame([("s", dt.date(2020, 1, 1), 1.0), ("s", dt.date(2020, 1, 2), 2.0)],
                                "location string, date date, ppt double")
    new = spark.createDataFrame([("s", dt.date(2020, 1, 2), 9.0), ("s", dt.date(2020, 1, 3), 3.0)],
                                "location string, date date, ppt double")
    out = {r["date"]: r["ppt"] for r in feeds.upsert(old, new, ["location", "date"]).collect()}
    assert out == {dt.date(2020, 1, 1): 1.0, dt.date(2020, 1, 2): 9.0, dt.date(2020, 1, 3): 3.0}


def test_merge_shipments_name_fix(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "new.csv")
    _write(p, "tuesday_week_ending,region,origin,district,commodity,volumes\n"
              "2022-01-04,CALIFORNIA,X,Oxnard District,Lettuce Iceberg ,12\n"
              "2022-01-04,CALIFORNIA,X,Unknown Place,Lettuce Iceberg,5\n")
    df = feeds.merge_shipments(spark, [feeds.read_shipments_named(spark, p)])
    got = sorted((r["district"], r["commodity"]) for r in df.collect())
    assert got == [("Oxnard", "Lettuce Iceberg"), ("Unknown Place", "Lettuce Iceberg")]


def test_keep_last_hot_key_is_partial_aggregate(spark):
    # One key holds most rows: the plan reduces it map-side (partial max_by).
    rows = [(0 if i % 3 else i, i, float(i)) for i in range(30000)]
    df = spark.createDataFrame(rows, "k int, seq long, v double").repartition(6)
    out = keep_last(df, ["k"], [F.col("seq")])
    got = {r["k"]: r["seq"] for r in out.collect()}
    assert got[0] == 29999 and len(got) == 1 + len({i for i in range(30000) if i % 3 == 0}) - 1
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    assert "partial_max_by" in buf.getvalue()


def test_write_table_partitioned_csv_and_parquet(spark, tmpdir_path):
    df = spark.createDataFrame([(2020, "a", 1.0), (2021, "b", 2.0), (2021, "a", 3.0)],
                               "year int, k string, v double")
    p1, p2 = os.path.join(tmpdir_path, "pq"), os.path.join(tmpdir_path, "csv")
    feeds.write_table(df, p1, sort_by=("k",))
    feeds.write_table(df, p2, fmt="csv")
    assert sorted(d for d in os.listdir(p1) if d.startswith("year=")) == ["year=2020", "year=2021"]
    back = spark.read.option("header", True).csv(p2)
    assert back.count() == 3 and set(back.columns) == {"k", "v", "year"}


def test_price_reader_keeps_quoted_text_and_empty_cells(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text('report_date,district,commodity,variety,organic,low_price,market_tone_comments,high_price\n'
                    '01/02/2024,D1,Lettuce,Romaine,N,10.5,"ABOUT ""STEADY"", LOWER",12\n'
                    '01/03/2024,D1,Lettuce,,,11,"FIRST LINE\nSECOND, LINE",13\n'
                    '01/04/2024,D2,Lettuce,Iceberg,Y,9,,10\n')
    rows = {r["report_date"].day: r for r in feeds.read_price_file(spark, str(path), 0, keep_districts=["D1"]).collect()}
    assert set(rows) == {2, 3}
    assert rows[2]["market_tone_comments"] == 'ABOUT "STEADY", LOWER'
    assert (rows[2]["low_price"], rows[2]["high_price"]) == ("10.5", "12")
    assert rows[3]["market_tone_comments"] == "FIRST LINE\nSECOND, LINE" and rows[3]["high_price"] == "13"
    assert (rows[3]["variety"], rows[3]["organic"]) == ("", "")     # empty cells stay empty
    assert rows[3]["package"] == "" and rows[2]["item_size"] == ""  # absent columns take their default


def test_shipment_readers_keep_quoted_text(spark, tmp_path):
    path = tmp_path / "ship.csv"
    path.write_text('tuesday_week_ending,region,origin,district,commodity,volumes\n'
                    '2024-01-02,"WEST, ""UPPER""",CA,D1,Lettuce,5\n')
    r = feeds.read_shipments_named(spark, str(path)).collect()
    assert len(r) == 1 and r[0]["volumes"] == 5.0 and r[0]["district"] == "D1"


def test_reports_are_dealt_without_a_pass_for_ranges(spark):
    rows = [(i % 40, 1, f"{v}") for i in range(200) for v in (i * 7 % 13,)]
    reports = spark.createDataFrame(rows, "order_key long, line_no int, origin string").repartition(6)
    dealt = feeds.in_report_order(reports, ["order_key", "line_no"], ["origin"])
    assert "rangepartitioning" not in dealt._jdf.queryExecution().toString()
    at = [(r.order_key, r.part, r.pos, r.origin) for r in dealt.select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")).collect()]
    for key in range(40):
        own = sorted((x for x in at if x[0] == key), key=lambda x: x[2])
        assert len({x[1] for x in own}) == 1 and [x[3] for x in own] == sorted(x[3] for x in own)
    assert len(at) == 200


def test_ingest_roundtrip_writes_without_ranges(spark, monkeypatch):
    from furrow.plans import q_ingest
    dealt = []
    ordered = feeds.in_report_order
    monkeypatch.setattr(feeds, "in_report_order", lambda *a: dealt.append(ordered(*a)) or dealt[-1])
    q_ingest.q_ingest_roundtrip(spark, "/root/testdata/sf0.001")
    assert len(dealt) == 2 and not any("rangepartitioning" in d._jdf.queryExecution().toString() for d in dealt)


def test_the_feeds_are_read_once_for_the_imputation_frame(spark, monkeypatch):
    from furrow.operators import impute
    from furrow.plans import q_trees
    seen = []
    frame = impute.imputation_frame
    monkeypatch.setattr(impute, "imputation_frame", lambda panel, *a: seen.append(panel) or frame(panel, *a))
    q_trees._impute_frame(spark, "/root/testdata/sf0.001")
    assert "parquet" not in seen[0]._jdf.queryExecution().executedPlan().toString().lower()
