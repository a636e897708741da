"""Ingest queries: keyed dedup (D1, D2) and a CSV round trip through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furrow import config as K
from furrow.operators.dedup import keep_first, keep_last, nulls_last
from furrow.plans import oracle as O
from furrow.plans.q_panel import PANEL_COLS, WX_COLS
from furrow.plans.registry import register
from furrow.plans.spec import kinds
from furrow.session import ensure_checkpoint_dir
from furrow.sources import feeds as FD
from furrow.sources import testmap

SHIP_REPORT_COLS = kinds("order_key:int line_no:int week_ending:date region:str origin:str "
                         "district:str commodity:str volumes")

_SHIP_REPORTS_SQL = "WITH " + O.feeds_cte().lstrip() + f""",
reports AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, {O.wk('l_shipdate')} AS week_ending,
         r_name AS region, s_name AS origin, n_name AS district, p_type AS commodity,
         CAST(l_quantity AS DOUBLE) AS volumes FROM li)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY order_key, line_no
     ORDER BY week_ending DESC, (region IS NULL) DESC, region DESC, district DESC,
              commodity DESC, origin DESC, volumes DESC) AS rn FROM reports)
WHERE rn = 1"""


@register("dedup_keep_last", SHIP_REPORT_COLS, _SHIP_REPORTS_SQL)
def q_dedup_keep_last(spark, sf_dir):
    """Shipment reports repeated under one report key — keep the row that
    sorts last by (week, region with missing last, district, commodity), then
    business tie-breaks; one partial aggregate (max_by), skew-safe."""
    r = testmap.shipment_reports(spark, sf_dir)
    order = [F.col("week_ending"), *nulls_last("region"), F.col("district"), F.col("commodity"),
             F.col("origin"), F.col("volumes")]
    return keep_last(r, ["order_key", "line_no"], order)


PRICE_REPORT_COLS = kinds("report_date:date district:str commodity:str variety:str package:str "
                          "item_size:str organic:str low_price high_price file_rank:int row_seq:int")

_PRICE_REPORTS_SQL = "WITH " + O.feeds_cte().lstrip() + """,
reports AS (
  SELECT CAST(l_shipdate AS DATE) AS report_date, n_name AS district, p_type AS commodity,
         p_brand AS variety, 'carton' AS package, CAST(p_size AS VARCHAR) AS item_size,
         l_returnflag AS organic, unit_price * (1 - l_discount) AS low_price,
         unit_price * (1 + l_tax) AS high_price, year(l_shipdate) AS file_rank,
         l_orderkey * 16 + l_linenumber AS row_seq FROM li)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY """ + ", ".join(K.PRICE_DEDUP_KEY) + """
     ORDER BY file_rank, row_seq, low_price, high_price) AS rn FROM reports)
WHERE rn = 1"""


@register("dedup_keep_first", PRICE_REPORT_COLS, _PRICE_REPORTS_SQL)
def q_dedup_keep_first(spark, sf_dir):
    """Price reports — the first row per 7-column key in file order
    (file rank, then position in the file)."""
    r = testmap.price_reports(spark, sf_dir)
    order = [F.col("file_rank"), F.col("row_seq"), F.col("low_price"), F.col("high_price")]
    return keep_first(r, K.PRICE_DEDUP_KEY, order)


_SHIP_ROUNDTRIP_SQL = "WITH " + O.feeds_cte().lstrip() + f""",
reports AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, {O.wk('l_shipdate')} AS week_ending,
         n_name AS district, p_type AS commodity, s_name AS origin,
         CAST(l_quantity AS DOUBLE) AS volumes FROM li),
files AS (
  SELECT 'old' AS f, * FROM reports WHERE year(week_ending) <= 1998
  UNION ALL SELECT 'new' AS f, * FROM reports WHERE year(week_ending) >= 1998),
surv AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY f, week_ending, district, commodity, order_key, line_no
                                 ORDER BY origin DESC, volumes DESC) AS rn FROM files)
  WHERE rn = 1)
SELECT week_ending, district, commodity, count(*) AS rows, sum(volumes) AS volume
FROM surv GROUP BY 1, 2, 3"""


@register("ingest_roundtrip", kinds("week_ending:date district:str commodity:str rows:int volume"),
          _SHIP_ROUNDTRIP_SQL)
def q_ingest_roundtrip(spark, sf_dir):
    """S1+S2+S9+U1+P1+P2+P4+P5+P9+D1+P11: shipment reports written as an older
    positional CSV (US dates, number formatting, district names in another
    spelling) and a newer named CSV (upper-case region and origin) that
    overlap in one year, read back through the readers, merged, deduplicated
    on (week, district, commodity, report), district spellings fixed from
    the nation table, then summed per (week, district, commodity). As in the
    reference rule, dedup runs before the spelling fix, so the overlap year's
    reports, spelled differently in the two files, are both kept and summed.
    Files go to the session's shared checkpoint folder."""
    base = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    r = testmap.shipment_reports(spark, sf_dir)
    y = F.year("week_ending")
    cut = 1998
    old_cols = [
        F.date_format("week_ending", "M/d/yyyy").alias("Week Ending"), F.col("region").alias("Region"),
        F.col("origin").alias("Origin"), F.initcap("district").alias("District"),
        F.col("commodity").alias("Commodity"),
        F.format_number("volumes", 0).alias("Volume"),
        F.concat_ws("-", "order_key", "line_no").alias("Report")]
    new_cols = [
        F.col("week_ending").cast("string").alias("tuesday_week_ending"),
        F.upper("region").alias("region"), F.upper("origin").alias("origin"), "district",
        "commodity", F.col("volumes").cast("string").alias("volumes"),
        F.concat_ws("-", "order_key", "line_no").alias("report")]
    order = ["week_ending", "district", "commodity", "origin", "volumes"]
    for part, cols, path in ((r.where(y <= cut), old_cols, f"{base}/old"),
                             (r.where(y >= cut), new_cols, f"{base}/new")):
        (FD.in_report_order(part, ["order_key", "line_no"], order).select(*cols)
             .write.mode("overwrite").option("header", True).csv(path))
    a = FD.read_shipments_positional(spark, f"{base}/old", source_rank=0, extra=["report"])
    b = FD.read_shipments_named(spark, f"{base}/new", source_rank=1, extra=["report"])
    # Spelling fix from the nation dimension: older spelling -> standard name.
    fix = testmap.table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("raw"),
                                                        F.col("n_name").alias("std"))
    merged = FD.merge_shipments(spark, [a, b], key=("week_ending", "district", "commodity", "report"),
                                name_fix=fix)
    return merged.groupBy("week_ending", "district", "commodity").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("volumes").alias("volume"))


@register("weather_weekly_stream", WX_COLS,
          "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM wx_w")
def q_weather_weekly_stream(spark, sf_dir):
    """S8 / A5+A6 as a stream: the daily weather feed lands as files in the shared
    checkpoint folder, later years first and the earlier ones as a backfill, and a
    Structured Streaming job (update mode, idempotent per-batch output) maintains
    the weekly aggregates; the newest version of every week must equal the batch
    result."""
    from furrow.streaming import weather as SW
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    daily = testmap.weather(spark, sf_dir)
    src = f"{base}/landing"
    middle = daily.select(F.floor((F.min(F.year("date")) + F.max(F.year("date"))) / 2)).first()[0]
    for part in (F.year("date") > middle, F.year("date") <= middle):
        daily.where(part).repartition(4).write.mode("append").parquet(src)
    SW.run_weekly_weather(spark, src, testmap.location_map(spark, sf_dir), f"{base}/out",
                          f"{base}/chk", files_per_batch=2)
    return SW.latest_weeks(spark, f"{base}/out")


_STREAM_UPSERT_SQL = "WITH " + O.panel_cte().lstrip().replace("FROM wx_rows w LEFT JOIN", """FROM (
    SELECT location, date, avg(tmax) AS tmax, avg(tmin) AS tmin, avg(ppt) AS ppt FROM wx_rows GROUP BY 1, 2) w LEFT JOIN""") + """
SELECT * FROM wx_w"""


@register("weather_stream_upsert", WX_COLS, _STREAM_UPSERT_SQL)
def q_weather_stream_upsert(spark, sf_dir):
    """S8 as an upserting stream: one reading a location and day lands as files, the first ten
    days of a month with wrong values (revision 0) that revision 1 corrects, for even months
    before the wrong ones arrive; some right days land twice. The weekly aggregates of the
    stream's newest readings must equal those of the right readings."""
    from furrow.streaming import weather as SW
    base = f"{ensure_checkpoint_dir(spark)}/upserts-{uuid.uuid4().hex}"
    right = testmap.weather(spark, sf_dir).groupBy("location", "date").agg(*(F.avg(c).alias(c) for c in ("tmax", "tmin", "ppt")))
    early, even = F.dayofmonth("date") <= 10, F.month("date") % 2 == 0
    wrong = right.where(early).withColumns({"tmax": F.col("tmax") + 5, "tmin": F.lit(None).cast("double"), "ppt": F.col("ppt") * 2 + 1})
    landings = [(right.where(early & even), 1), (wrong.unionByName(right.where(~early)), 0),
                (right.where(early & ~even), 1), (right.where(F.dayofmonth("date") == 20), 0)]
    for rows, revision in landings:
        rows.withColumn("revision", F.lit(revision).cast("bigint")).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    SW.run_upserted_weather(spark, f"{base}/landing", f"{base}/out", f"{base}/chk", files_per_batch=2)
    return SW.upserted_weeks(spark, f"{base}/out", testmap.location_map(spark, sf_dir))


_UPSERT_SQL = "WITH " + O.feeds_cte().lstrip() + """,
new AS (SELECT location, date, avg(tmax) AS tmax, avg(tmin) AS tmin, avg(ppt) AS ppt
        FROM wx_rows WHERE month(date) >= 6 GROUP BY 1, 2),
old AS (SELECT location, date, min(tmax) AS tmax, min(tmin) AS tmin, min(ppt) AS ppt
        FROM wx_rows WHERE month(date) <= 9 GROUP BY 1, 2)
SELECT location, date, n.tmax, n.tmin, n.ppt FROM new n
UNION ALL
SELECT location, date, tmax, tmin, ppt FROM old o
WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.location = o.location AND n.date = o.date)"""


@register("weather_upsert", kinds("location:str date:date tmax tmin ppt"), _UPSERT_SQL)
def q_weather_upsert(spark, sf_dir):
    """S8 as a batch: a stored daily table (January to September) and a fetch of June
    to December; days in both keep the fetched reading, all others stay."""
    daily = testmap.weather(spark, sf_dir)
    pick = lambda f: [f(c).alias(c) for c in ("tmax", "tmin", "ppt")]
    stored = daily.where(F.month("date") <= 9).groupBy("location", "date").agg(*pick(F.min))
    fetched = daily.where(F.month("date") >= 6).groupBy("location", "date").agg(*pick(F.avg))
    return FD.upsert(stored, fetched, ["location", "date"])


@register("panel_table_roundtrip", PANEL_COLS,
          "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM panel")
def q_panel_table_roundtrip(spark, sf_dir):
    """S9+O1: the weekly panel written as a year-partitioned Parquet table
    (rows sorted by week and district inside each file) in the shared
    checkpoint folder, then read back whole."""
    from furrow.plans.q_panel import build_panel
    path = f"{ensure_checkpoint_dir(spark)}/panel-{uuid.uuid4().hex}"
    FD.write_table(build_panel(spark, sf_dir), path, partition_by=("year",),
                   sort_by=("week_ending", "district"))
    return spark.read.parquet(path)


@register("panel_bucketed", PANEL_COLS, "WITH " + O.panel_cte().lstrip() + "\nSELECT * FROM panel")
def q_panel_bucketed(spark, sf_dir):
    """S9+J1+O1: the three weekly tables written bucketed by (week, district), rows sorted
    inside each bucket, then joined bucket by bucket, without a shuffle."""
    from furrow.config import DRIVER as CFG
    from furrow.operators import panel
    f = testmap.feeds(spark, sf_dir)
    run = uuid.uuid4().hex
    base = f"{ensure_checkpoint_dir(spark)}/bucketed-{run}"
    weekly = {"ship": panel.shipments_weekly(panel.shipments_long(f["shipments"], f["shipment_map"], CFG), CFG),
              "price": panel.prices_weekly(panel.price_points(f["prices"], f["price_map"], CFG), CFG),
              "wx": panel.weather_weekly(f["weather"], f["location_map"])}
    tables = [FD.write_bucketed(df, f"{name}_{run}", f"{base}/{name}", panel.KEY, 8) for name, df in weekly.items()]
    return panel.join_panel(*tables, CFG)


_DEDUPED_PANEL_SQL = "WITH " + O.panel_cte().lstrip().replace(
    "FROM ship s", "FROM ship_d s").replace("FROM price_rows p", "FROM price_d p").replace(
    ",\nship_long AS", f""",
ship_d AS (
  SELECT * FROM (
    SELECT {O.wk('l_shipdate')} AS week_ending, r_name AS region, s_name AS origin, n_name AS district,
           p_type AS commodity, CAST(l_quantity AS DOUBLE) AS volumes,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber
             ORDER BY {O.wk('l_shipdate')} DESC, (r_name IS NULL) DESC, r_name DESC, n_name DESC,
                      p_type DESC, s_name DESC, l_quantity DESC) AS rn FROM li)
  WHERE rn = 1),
price_d AS (
  SELECT *, NULL::DOUBLE AS mostly_low_price, NULL::DOUBLE AS mostly_high_price FROM (
    SELECT CAST(l_shipdate AS DATE) AS report_date, n_name AS district, p_type AS commodity,
           p_brand AS variety, 'carton' AS package, CAST(p_size AS VARCHAR) AS item_size,
           l_returnflag AS organic, unit_price * (1 - l_discount) AS low_price,
           unit_price * (1 + l_tax) AS high_price,
           row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), n_name, p_type, p_brand, p_size, l_returnflag
             ORDER BY year(l_shipdate), l_orderkey * 16 + l_linenumber,
                      unit_price * (1 - l_discount), unit_price * (1 + l_tax)) AS rn FROM li)
  WHERE rn = 1),
ship_long AS""") + "\nSELECT * FROM panel"


@register("weekly_panel_deduped", PANEL_COLS, _DEDUPED_PANEL_SQL)
def q_weekly_panel_deduped(spark, sf_dir):
    """D1+D2 in front of J1: raw shipment reports keep the last row a report key, raw
    price reports the first row a 7-column key, and the panel is built from those."""
    from furrow.config import DRIVER as CFG
    from furrow.operators import panel
    none = F.lit(None).cast("double")
    feeds = testmap.feeds(spark, sf_dir) | {
        "shipments": q_dedup_keep_last(spark, sf_dir),
        "prices": q_dedup_keep_first(spark, sf_dir).withColumns({"mostly_low_price": none, "mostly_high_price": none})}
    return panel.weekly_panel(feeds, CFG)


PRICE_INGEST_COLS = kinds("report_date:date district:str commodity:str variety:str package:str "
                          "item_size:str organic:str low_price high_price file_rank:int")
# The word a commodity must hold and the districts kept.
PRICE_WORD = "PROMO"
PRICE_DISTRICTS = tuple(f"NATION_{i}" for i in (0, 2, 3, 5, 7, 11, 13, 17, 19, 23))
DEFAULTS_YEAR = 1997  # this year's file is written without variety and item_size

_PRICE_INGEST_SQL = "WITH " + O.feeds_cte().lstrip() + f""",
reports AS (
  SELECT CAST(l_shipdate AS DATE) AS report_date, n_name AS district, p_type AS commodity,
         CASE WHEN year(l_shipdate) = {DEFAULTS_YEAR} THEN 'N/A' ELSE p_brand END AS variety,
         'carton' AS package,
         CASE WHEN year(l_shipdate) = {DEFAULTS_YEAR} THEN '' ELSE CAST(p_size AS VARCHAR) END
           AS item_size,
         l_returnflag AS organic, unit_price * (1 - l_discount) AS low_price,
         unit_price * (1 + l_tax) AS high_price,
         year(l_shipdate) - (SELECT min(year(l_shipdate)) FROM li) AS file_rank,
         l_orderkey * 16 + l_linenumber AS row_seq FROM li)
SELECT * EXCLUDE (rn, row_seq) FROM (
  SELECT *, row_number() OVER (PARTITION BY {", ".join(K.PRICE_DEDUP_KEY)}
     ORDER BY file_rank, row_seq) AS rn FROM reports
  WHERE commodity LIKE '%{PRICE_WORD}%' AND district IN {O._in(PRICE_DISTRICTS)})
WHERE rn = 1"""


@register("price_ingest_roundtrip", PRICE_INGEST_COLS, _PRICE_INGEST_SQL)
def q_price_ingest_roundtrip(spark, sf_dir):
    """S3+S4+P3+P5+P6+P7+D2: price reports written as one CSV folder per year (rows in
    report order, dates as MM/DD/YYYY text, one year's file without the variety
    and item-size columns), read back in year order through the price reader
    (absent columns take their defaults, texts trimmed, date parsed, rows kept
    whose commodity holds a word and whose district is listed), then the first
    row per 7-column key in file order."""
    base = f"{ensure_checkpoint_dir(spark)}/prices-{uuid.uuid4().hex}"
    r = testmap.price_reports(spark, sf_dir)
    cols = [F.date_format("report_date", "MM/dd/yyyy").alias("report_date"), "district", "commodity", "variety", "package",
            "item_size", "organic", *(F.col(c).cast("string").alias(c) for c in ("low_price", "high_price"))]
    short = [c for c in cols if not (isinstance(c, str) and c in ("variety", "item_size"))]
    # Part files are range-partitioned and sorted by report order within a year, so (file
    # name, position) is the report order.
    dealt = r.repartitionByRange("file_rank", "row_seq").sortWithinPartitions("file_rank", "row_seq")
    for rows, kept in ((dealt.where(F.col("file_rank") != DEFAULTS_YEAR), cols), (dealt.where(F.col("file_rank") == DEFAULTS_YEAR), short)):
        rows.select(*kept, "file_rank").write.mode("append").option("header", True).partitionBy("file_rank").csv(base)
    span = r.agg(F.min("file_rank"), F.max("file_rank")).first()
    paths = [f"{base}/file_rank={y}" for y in range(span[0], span[1] + 1)]
    cleaned = FD.read_prices(spark, paths, commodity_contains=PRICE_WORD, keep_districts=PRICE_DISTRICTS)
    return cleaned.select(*[c for c, _ in PRICE_INGEST_COLS if c not in ("low_price", "high_price")],
                          F.col("low_price").cast("double").alias("low_price"),
                          F.col("high_price").cast("double").alias("high_price"))


WX_WIDE_COLS = kinds("location:str date:date tmax tmin ppt district:str")

_WX_WIDE_SQL = "WITH " + O.feeds_cte().lstrip() + """,
rng AS (SELECT location, min(date) AS a, max(date) AS b FROM wx_rows GROUP BY 1),
days AS (SELECT location, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM rng),
dm AS (SELECT location, date, avg(tmax) AS tmax, avg(tmin) AS tmin, avg(ppt) AS ppt
       FROM wx_rows GROUP BY 1, 2)
SELECT d.location, d.date, dm.tmax, dm.tmin, dm.ppt, d.location AS district
FROM days d LEFT JOIN dm ON d.location = dm.location AND d.date = dm.date"""


def _field(name):
    return lambda e: e[name]


@register("weather_payload_roundtrip", WX_WIDE_COLS, _WX_WIDE_SQL)
def q_weather_payload_roundtrip(spark, sf_dir):
    """S5+S6+S7: every location's date range is split into 365-day chunks (S6);
    each (location, variable, chunk) becomes one API-style JSON payload of daily
    values (the test readings' daily mean, null on days without one); the
    payloads are parsed back into daily rows (S5) and pivoted to one row per
    (location, day) with the district from the location dimension (S7)."""
    daily = testmap.weather(spark, sf_dir)
    ranges = daily.groupBy("location").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    chunks = FD.chunk_ranges(ranges, "start", "end", 365)
    # Stand-in API answers: one array of daily values per chunk and variable.
    means = daily.groupBy("location", "date").agg(F.avg("tmax").alias("tmax"),
                                                  F.avg("tmin").alias("tmin"),
                                                  F.avg("ppt").alias("ppt"))
    days = chunks.select("location", "chunk_start",
                         F.explode(F.sequence("chunk_start", "chunk_end")).alias("date"))
    filled = days.join(means, ["location", "date"], "left")
    per_chunk = filled.groupBy("location", "chunk_start").agg(
        F.array_sort(F.collect_list(F.struct("date", "tmax", "tmin", "ppt"))).alias("d"))
    payloads = per_chunk.select(
        "location", F.col("chunk_start").cast("string").alias("start_date"),
        F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.to_json(F.struct(
            F.struct(F.create_map(F.lit(v), F.transform("d", _field(v))).alias("data"))
            .alias("result"), F.lit(None).cast("string").alias("errors"))).alias("payload"))
            for v in ("tmax", "tmin", "ppt")])).alias("p")).select(
        "location", "p.variable", "start_date", "p.payload")
    long = FD.daily_from_payload(payloads)
    return FD.weather_wide(long, testmap.location_map(spark, sf_dir))
