"""Driver test tables -> the three feed schemas (shipments, prices, weather).

This module only renames and reshapes columns so that the test tables look
like the feeds; it does no aggregation, dedup or cleaning (that is the job of
the pipeline). Mapping (FIXTURES.md section 3):

* shipments: one row per line item — week_ending = Tuesday week of the ship
  date, region = supplier region name, origin = supplier name, district (raw)
  = supplier nation name, commodity = part type, volumes = quantity.
* prices: the same line items as daily price reports in the cleaned (silver)
  price schema — report_date = ship date, organic = return flag, numeric
  low/high/mostly prices (the 'mostly' pair is missing when the discount is 0).
* weather: one daily reading per order — location = customer region name,
  date = order date, deterministic tmin/tmax/ppt formulas.
* district maps: raw nation name -> region name (many to one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.columns import week_ending_tuesday

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _supplier_geo(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select("s_suppkey", "s_name", "n_name", "r_name"))


def _line_items(spark, sf_dir, cols):
    li = table(spark, sf_dir, "lineitem").select(*cols)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    geo = _supplier_geo(spark, sf_dir)
    # Dimension sides are broadcast only below a checked row count; beyond it
    # (supplier and part grow with the scale factor) Spark joins by shuffle.
    # The supplier geography is many-to-one joins on supplier, so the
    # supplier table's own count bounds it.
    supplier = table(spark, sf_dir, "supplier")
    return (li.join(geo, li.l_suppkey == geo.s_suppkey)
              .join(p, li.l_partkey == p.p_partkey))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipment feed rows: week_ending, region, origin, district, commodity, volumes."""
    j = _line_items(spark, sf_dir, ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"])
    return j.select(
        week_ending_tuesday("l_shipdate").alias("week_ending"),
        F.col("r_name").alias("region"),
        F.col("s_name").alias("origin"),
        F.col("n_name").alias("district"),
        F.col("p_type").alias("commodity"),
        F.col("l_quantity").cast("double").alias("volumes"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price report rows in the cleaned price schema (numeric prices)."""
    j = _line_items(spark, sf_dir, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                                    "l_discount", "l_tax", "l_returnflag", "l_shipdate"])
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    mostly = F.when(F.col("l_discount") != 0, unit)
    return j.select(
        F.to_date("l_shipdate").alias("report_date"),
        F.col("n_name").alias("district"),
        F.col("p_type").alias("commodity"),
        F.col("p_brand").alias("variety"),
        F.lit("carton").alias("package"),
        F.col("p_size").cast("string").alias("item_size"),
        F.col("l_returnflag").alias("organic"),
        (unit * (1 - F.col("l_discount"))).alias("low_price"),
        (unit * (1 + F.col("l_tax"))).alias("high_price"),
        mostly.alias("mostly_low_price"),
        mostly.alias("mostly_high_price"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather rows: location, date, tmax, tmin, ppt."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select("c_custkey", "r_name"))
    j = o.join(geo,
               o.o_custkey == geo.c_custkey)
    tmin = ((F.col("o_custkey") * 37) % 250) / 10.0 - 1.0
    return j.select(
        F.col("r_name").alias("location"),
        F.to_date("o_orderdate").alias("date"),
        (tmin + F.col("o_totalprice") / 20000.0).alias("tmax"),
        tmin.alias("tmin"),
        ((F.col("o_orderkey") * 13) % 7).cast("double").alias("ppt"),
    )


def district_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw district (nation name) -> panel district (region name)."""
    n = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_name").alias("raw"), F.col("r_name").alias("std")))


def location_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather location -> panel district (locations are region names here)."""
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("location"), F.col("r_name").alias("district"))


def feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All inputs of the panel build, keyed by role."""
    dm = district_map(spark, sf_dir)
    return {
        "shipments": shipments(spark, sf_dir),
        "prices": prices(spark, sf_dir),
        "weather": weather(spark, sf_dir),
        "shipment_map": dm,
        "price_map": dm,
        "location_map": location_map(spark, sf_dir),
    }


def shipment_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipment rows with their report identity (order key, line number)."""
    j = _line_items(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    "l_quantity", "l_shipdate"])
    return j.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        week_ending_tuesday("l_shipdate").alias("week_ending"),
        F.col("r_name").alias("region"), F.col("s_name").alias("origin"),
        F.col("n_name").alias("district"), F.col("p_type").alias("commodity"),
        F.col("l_quantity").cast("double").alias("volumes"))


def price_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows with a file rank (the yearly file) and a position in the file."""
    j = _line_items(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                    "l_returnflag", "l_shipdate"])
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return j.select(
        F.to_date("l_shipdate").alias("report_date"),
        F.col("n_name").alias("district"), F.col("p_type").alias("commodity"),
        F.col("p_brand").alias("variety"), F.lit("carton").alias("package"),
        F.col("p_size").cast("string").alias("item_size"),
        F.col("l_returnflag").alias("organic"),
        (unit * (1 - F.col("l_discount"))).alias("low_price"),
        (unit * (1 + F.col("l_tax"))).alias("high_price"),
        F.year("l_shipdate").alias("file_rank"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row_seq"))
