"""Raw feed readers and cleaning.

Files are read by Spark's CSV / JSON readers with explicit schemas or as
text; cleaning is column expressions; dedup is one partial aggregate.
Each reader adds ``source_rank`` / ``file_rank`` and ``row_seq`` (see
``file_order``) so that "first in file order" and "last after a stable sort"
are well defined.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import config as K
from furrow.functions.aggregates import literal_table
from furrow.functions.columns import parse_date_mixed, parse_date_us, parse_number, title_case
from furrow.operators.dedup import keep_first, keep_last, price_order, shipment_order

SHIPMENT_COLUMNS = ["week_ending", "region", "origin", "district", "commodity", "volumes"]


def file_order():
    """Position of a row in its input: (file path, split start, position in the
    split). Orders rows of one file by position and files by name, also when
    a file is read in many splits or a folder holds many part files."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"))


def in_report_order(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of one report are in one partition, sorted by ``order``, so the file order of
    repeated reports is defined by their content. By hash: ranges would take a pass over
    all that ``rows`` are made from, for a sample of their keys."""
    return rows.repartition(*key).sortWithinPartitions(*key, *order)


# ------------------------------------------------------------- shipments

def csv_reader(spark: SparkSession, multi_line: bool):
    """CSV with a header, quoted cells and doubled quotes inside them.
    ``multi_line`` also reads line breaks inside quoted cells; such a file is
    not split, so turn it off for large files without them."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line))


def read_shipments_positional(spark: SparkSession, path: str | Sequence[str],
                              source_rank: int = 0, extra: Sequence[str] = (),
                              multi_line: bool = False) -> DataFrame:
    """Older shipment file — first six columns by position, header skipped,
    further columns ignored unless named in ``extra`` (taken by position
    after the six); mixed date formats (P2); thousands commas (P1)."""
    names = SHIPMENT_COLUMNS + list(extra)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = (csv_reader(spark, multi_line).option("enforceSchema", True)
           .option("mode", "PERMISSIVE").schema(schema).csv(path))
    return raw.select(
        parse_date_mixed("week_ending").alias("week_ending"),
        "region", "origin", "district", "commodity",
        parse_number("volumes").alias("volumes"),
        F.lit(source_rank).alias("source_rank"),
        file_order().alias("row_seq"),
        *extra,
    )


def read_shipments_named(spark: SparkSession, path: str | Sequence[str],
                         source_rank: int = 1, date_column: str = "tuesday_week_ending",
                         extra: Sequence[str] = (), multi_line: bool = False) -> DataFrame:
    """Newer shipment file — columns by name, one renamed; region and origin
    title-cased (P4); plain numeric coercion of volumes; ``extra`` columns kept."""
    raw = csv_reader(spark, multi_line).csv(path)
    vol = F.trim(F.col("volumes")).try_cast("double")
    return raw.select(
        parse_date_mixed(date_column).alias("week_ending"),
        title_case("region").alias("region"),
        title_case("origin").alias("origin"),
        "district", "commodity",
        F.when(~F.isnan(vol), vol).alias("volumes"),
        F.lit(source_rank).alias("source_rank"),
        file_order().alias("row_seq"),
        *extra,
    )


def merge_shipments(spark: SparkSession, parts: Sequence[DataFrame],
                    key: Sequence[str] = ("week_ending", "district", "commodity"),
                    name_fix: Sequence[tuple[str, str]] | DataFrame | None = K.SHIPMENT_NAME_FIX
                    ) -> DataFrame:
    """U1 + P9 + D1 + P11 + P5: union, drop rows without week or volume, keep
    the last row per key after the stable sort, fix district spellings
    (a fixed list or a (raw, std) dimension table; unmatched kept), trim the
    commodity. Dedup runs before the spelling fix, so rows spelled
    differently are both kept and summed later."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.where(F.col("week_ending").isNotNull() & F.col("volumes").isNotNull())
    df = keep_last(df, list(key), shipment_order(["origin", "volumes"]))
    if name_fix is not None:
        m = (name_fix.select("raw", "std") if isinstance(name_fix, DataFrame)
             else literal_table(spark, name_fix, "raw string, std string"))
        df = (df.join(m, df["district"] == m["raw"], "left")
                .withColumn("district", F.coalesce("std", "district")).drop("raw", "std"))
    return df.withColumn("commodity", F.trim("commodity"))


# ---------------------------------------------------------------- prices

def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)                       # lists the path only
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return False
        raise
    return True


def _local_name(path: str) -> str:
    """A path as the scan reports it, without scheme and escapes."""
    return unquote(re.sub(r"^file:(//)?(?=/)", "", path)).rstrip("/")


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """First line -> files, of all files under ``paths``: one text scan, one row a file."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value").where(F.col("block") == 0)
    first = lines.groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        out.setdefault(r["header"], []).append(r["file"])
    return out


def read_price_files(spark: SparkSession, files: Sequence[str], ranks: DataFrame,
                     commodity_contains: str = "Lettuce",
                     keep_districts: Sequence[str] | None = K.PRICE_KEEP_DISTRICTS,
                     multi_line: bool = True) -> DataFrame:
    """S4 + P3 + P5-P7 for report files of one header: absent columns take their default
    (an empty cell stays empty), texts are trimmed, comments may hold quotes,
    commas and line breaks, rows need the commodity word, a kept district and a
    valid MM/DD/YYYY date. ``ranks`` (file, file_rank) gives each file's precedence."""
    raw = csv_reader(spark, multi_line).csv(list(files))
    have = set(raw.columns)
    col = (lambda c, d: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in have else F.lit(d))
    commodity_raw = F.coalesce(F.col("commodity"), F.lit("")) if "commodity" in have else F.lit("")
    district = F.trim(F.col("district")) if "district" in have else F.lit("")
    out = raw.select(
        parse_date_us(F.col("report_date") if "report_date" in have else F.lit(None)).alias("report_date"),
        district.alias("district"),
        F.trim(commodity_raw).alias("commodity"),
        *[col(c, d).alias(c) for c, d in K.PRICE_COLUMN_DEFAULTS],
        commodity_raw.contains(commodity_contains).alias("_keep_c"),
        F.col("_metadata.file_path").alias("_file"),
        file_order().alias("row_seq"),
    )
    cond = F.col("_keep_c") & F.col("report_date").isNotNull()
    if keep_districts is not None:
        cond = cond & F.col("district").isin(list(keep_districts))
    out = out.where(cond).drop("_keep_c")
    return out.join(ranks, out["_file"] == ranks["file"]).drop("_file", "file")


def read_price_file(spark: SparkSession, path: str, file_rank: int, **kw) -> DataFrame | None:
    """One report file or folder; None for a missing one."""
    if not _exists(spark, path):
        return None
    parts = [read_price_files(spark, [unquote(f) for f in files],
                              literal_table(spark, [(f, file_rank) for f in files], "file string, file_rank int"), **kw)
             for files in _headers(spark, [path]).values()]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def read_prices(spark: SparkSession, paths: Sequence[str], **kw) -> DataFrame:
    """S3 + D2: report files (or folders) in precedence order (yearly, then extras); missing
    ones are skipped. Files of the same header are one scan, whatever their number; a rank
    table joined on the file's path gives the precedence; then the first row per 7-column
    key in file order."""
    there = [(rank, path) for rank, path in enumerate(paths) if _exists(spark, path)]
    if not there:
        raise FileNotFoundError("no price file found")
    headers = _headers(spark, [path for _, path in there])
    rank_of = {_local_name(path): rank for rank, path in reversed(there)}

    def rank(file: str) -> int:
        name = _local_name(file)
        while name not in rank_of and "/" in name:
            name = name.rpartition("/")[0]
        return rank_of[name]

    ranks = literal_table(spark, [(file, rank(file)) for files in headers.values() for file in files], "file string, file_rank int")
    parts = [read_price_files(spark, [unquote(f) for f in files], ranks, **kw) for files in headers.values()]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return keep_first(df, K.PRICE_DEDUP_KEY, price_order())


# --------------------------------------------------------------- weather

PAYLOAD_SCHEMA = "struct<result:struct<data:map<string,array<double>>>,errors:string>"


def daily_from_payload(payloads: DataFrame) -> DataFrame:
    """(location, variable, start_date, payload JSON) -> (location, variable,
    date, value). Payloads that report errors yield no rows (see ``payload_errors``)."""
    p = payloads.select("location", "variable", F.to_date("start_date").alias("start_date"),
                        F.from_json("payload", PAYLOAD_SCHEMA).alias("j"))
    p = p.where(F.col("j.errors").isNull() | (F.trim(F.col("j.errors")) == "")
                | (F.col("j.errors") == "[]"))
    vals = F.element_at(F.col("j.result.data"), F.col("variable"))
    return p.select("location", "variable", "start_date", F.posexplode(vals).alias("pos", "value")) \
            .select("location", "variable", F.date_add("start_date", F.col("pos")).alias("date"),
                    "value")


def payload_errors(payloads: DataFrame) -> DataFrame:
    """Payloads whose API answer carried an error (reported, not dropped silently)."""
    p = payloads.select("location", "variable", "start_date",
                        F.from_json("payload", PAYLOAD_SCHEMA).alias("j"))
    return p.where(F.col("j.errors").isNotNull() & (F.trim(F.col("j.errors")) != "")
                   & (F.col("j.errors") != "[]")).select("location", "variable", "start_date",
                                                         F.col("j.errors").alias("errors"))


def chunk_ranges(ranges: DataFrame, start: str = "start", end: str = "end",
                 days: int = 365) -> DataFrame:
    """S6 per row: each [start, end] range split into chunks of ``days`` days
    (chunk_start, chunk_end); the last chunk is kept even when it is a single
    day. Other columns of ``ranges`` are carried along."""
    seq = F.sequence(F.to_date(F.col(start)), F.to_date(F.col(end)), F.expr(f"INTERVAL {days} DAYS"))
    keep = [c for c in ranges.columns if c not in (start, end)]
    return (ranges.select(*keep, F.to_date(F.col(end)).alias("_end"),
                          F.explode(seq).alias("chunk_start"))
                  .select(*keep, "chunk_start",
                          F.least(F.date_add("chunk_start", days - 1), F.col("_end")).alias("chunk_end")))


def date_chunks(spark: SparkSession, start: str, end: str, days: int = 365) -> DataFrame:
    """[start, end] split into chunks of ``days`` days."""
    one = spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end"))
    return chunk_ranges(one, "start", "end", days)


def weather_wide(daily_long: DataFrame, locations: DataFrame | None = None,
                 variables: Sequence[str] = ("tmax", "tmin", "ppt")) -> DataFrame:
    """Long (location, variable, date, value) -> one row per (location,
    date) with a column per variable (explicit pivot values: no extra job);
    the location dimension adds the district."""
    wide = daily_long.groupBy("location", "date").pivot("variable", list(variables)).agg(F.first("value"))
    if locations is not None:
        wide = wide.join(locations.select("location", "district"), "location", "left")
    return wide


def location_table(spark: SparkSession, rows=K.WEATHER_LOCATIONS) -> DataFrame:
    return literal_table(spark, rows, "location string, lat double, lon double, elev int, district string")


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append new rows to a stored table; a key present in both keeps the
    new row (no duplicate days when a location is fetched twice)."""
    a = existing.withColumn("_src", F.lit(0))
    b = new.select(*existing.columns).withColumn("_src", F.lit(1))
    cols = existing.columns
    both = a.unionByName(b)
    return keep_last(both, list(key), [F.col("_src")] + [F.col(c) for c in cols if c not in key]) \
        .drop("_src")


# ------------------------------------------------------------------ sink

def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",),
                fmt: str = "parquet", sort_by: Sequence[str] = ()) -> None:
    """S9 + O1: overwrite a table partitioned by year; rows sorted inside files."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int,
                   sort_by: Sequence[str] | None = None) -> DataFrame:
    """S9 + O1: ``df`` as a table bucketed by ``keys`` (files at ``path``), rows sorted inside
    each bucket. Tables of equal buckets join on ``keys`` without a shuffle. One task writes
    each bucket, so a bucket is one file."""
    spark = df.sparkSession
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
       .bucketBy(buckets, *keys).sortBy(*(sort_by or keys)).saveAsTable(table))
    return spark.table(table)
