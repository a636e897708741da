"""Incremental weekly weather with Structured Streaming.

Two feeds. Append-only readings (each lands once) keep running weekly aggregates in
state: ``run_weekly_weather``. Readings that are fetched again, repeated or corrected are
upserted by (location, date): ``run_upserted_weather`` below.

Daily readings arrive as files, in any order: a new station's whole history may
come long after later weeks of others. The stream maps stations to districts,
keys each reading by the end of its Tuesday week and keeps running weekly
aggregates in state. State holds one row a week and district, as many as the
result table has, so no watermark evicts weeks and no late reading is lost.
Updated weeks are written per micro-batch into a folder named after the batch id,
so a retried batch overwrites its own output (idempotent); ``latest_weeks`` reads
the newest version of every week and ``compact_weeks`` writes it as one table.

The upserting stream is keyed by (location, week): a key's state holds its days' newest
readings, at most seven. A reading replaces the one of its day when its revision is
not lower (of equal revisions the later arrival counts), and the whole week of the
location is put out again, which takes the old value back. ``latest_readings`` is then
the table that a batch ``upsert`` of all arrivals gives, and ``upserted_weeks`` its
weekly aggregates. Each batch writes its own folder, as above.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from furrow.functions.columns import week_ending_tuesday
from furrow.operators.dedup import keep_last
from furrow.operators.panel import weather_aggregates, weather_daily, weather_derived, weather_weekly

DAILY_SCHEMA = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("tmax", T.DoubleType()),
    T.StructField("tmin", T.DoubleType()),
    T.StructField("ppt", T.DoubleType()),
])

REVISED_SCHEMA = T.StructType([*DAILY_SCHEMA, T.StructField("revision", T.LongType())])
_VALUES = ("tmax", "tmin", "ppt")
_STATE = "days string"
_STATION_DAYS = "location string, week_ending date, date date, tmax double, tmin double, ppt double"


def weekly_weather_stream(daily: DataFrame, location_map: DataFrame) -> DataFrame:
    """Streaming (or batch) daily rows -> weekly district weather with flags."""
    d = weather_daily(daily, location_map).withColumn("week_ending", week_ending_tuesday("date"))
    return weather_derived(d.groupBy("week_ending", "district").agg(*weather_aggregates()))


def run_weekly_weather(spark: SparkSession, source_dir: str, location_map: DataFrame,
                       out_dir: str, checkpoint_dir: str, files_per_batch: int = 1) -> None:
    """Process every file present under ``source_dir`` (availableNow) and
    write updated weeks per micro-batch."""
    src = (spark.readStream.schema(DAILY_SCHEMA)
           .option("maxFilesPerTrigger", files_per_batch).parquet(source_dir))
    weekly = weekly_weather_stream(src, location_map)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id))
              .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}"))

    q = (weekly.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_weeks(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest state of every (week, district) written by the stream."""
    df = spark.read.parquet(out_dir)
    return keep_last(df, ["week_ending", "district"], [F.col("batch_id")]).drop("batch_id")


def compact_weeks(spark: SparkSession, out_dir: str, table_dir: str) -> DataFrame:
    """Write the newest state of every week as one table outside ``out_dir``."""
    latest_weeks(spark, out_dir).write.mode("overwrite").parquet(table_dir)
    return spark.read.parquet(table_dir)


# ---------------------------------------------------------------- upserts

def _replace_days(key, frames, state):
    """The newest reading of each day of one location's week."""
    held = json.loads(state.get[0]) if state.exists else {}
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["revision", "arrived", "file", *_VALUES], na_position="first", kind="stable")
    for r in rows.itertuples(index=False):
        day = pd.Timestamp(r.date).strftime("%Y-%m-%d")
        if day not in held or r.revision >= held[day][0]:
            held[day] = [int(r.revision), *(None if pd.isna(v) else float(v) for v in (r.tmax, r.tmin, r.ppt))]
    state.update((json.dumps(held),))
    days = sorted(held)
    out = pd.DataFrame({"location": key[0], "week_ending": key[1], "date": pd.to_datetime(days).date})
    for i, name in enumerate(_VALUES, 1):
        out[name] = pd.Series([held[d][i] for d in days], dtype="float64")
    yield out


def station_days(daily: DataFrame) -> DataFrame:
    """Streaming readings (location, date, tmax, tmin, ppt, revision, arrived, file) -> all
    days of each (location, week) that changed."""
    rows = (daily.where(F.col("location").isNotNull() & F.col("date").isNotNull())
            .withColumns({"week_ending": week_ending_tuesday("date"), "revision": F.coalesce("revision", F.lit(0))}))
    return rows.groupBy("location", "week_ending").applyInPandasWithState(
        _replace_days, _STATION_DAYS, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_upserted_weather(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                         files_per_batch: int = 1) -> None:
    """Process every file present under ``source_dir`` (availableNow; ``revision`` may be absent)
    and write the changed station weeks per micro-batch."""
    src = (spark.readStream.schema(REVISED_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
           .select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = (station_days(src).writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_readings(spark: SparkSession, out_dir: str) -> DataFrame:
    """(location, date, tmax, tmin, ppt): the newest state of every station week."""
    df = spark.read.parquet(out_dir)
    newest = df.groupBy("location", "week_ending").agg(F.max("batch_id").alias("batch_id"))
    values = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in _VALUES]
    return df.join(newest, ["location", "week_ending", "batch_id"], "left_semi").select("location", "date", *values)


def upserted_weeks(spark: SparkSession, out_dir: str, location_map: DataFrame) -> DataFrame:
    """Weekly district weather of the newest readings."""
    return weather_weekly(latest_readings(spark, out_dir), location_map)
