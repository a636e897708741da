"""Names found in a feed, kept in a register between runs.

A pivot needs its values before the plan is made. ``register_names`` finds the
distinct values of a column in one aggregate, appends the new ones in order of
their text to the register stored in a shared folder, and returns all of them in
register order: column order never changes between runs, a name once seen keeps
its place, and names that a run doesn't hold stay (their columns are missing
values there). The number of names is bounded by ``limit``; beyond it the run
fails, since a column per name was asked for.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 500
SCHEMA = "place int, name string"


def read_register(spark: SparkSession, path: str) -> list[str]:
    """Names of the newest version of the register at ``path``, in order; none if there is none."""
    try:
        versions = spark.read.schema(f"{SCHEMA}, version int, run string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    newest = versions.agg(F.max(F.struct("version", "run")).alias("v")).first()["v"]
    if newest is None:
        return []
    rows = versions.where((F.col("version") == newest["version"]) & (F.col("run") == newest["run"])).orderBy("place")
    return [r["name"] for r in rows.collect()]


def register_names(df: DataFrame, column: str, path: str, limit: int = LIMIT) -> list[str]:
    """All names of the register at ``path`` after adding those of ``df``'s ``column``."""
    spark = df.sparkSession
    known = read_register(spark, path)
    found = df.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    fresh = sorted(r["name"] for r in found.limit(limit + 1 + len(known)).collect() if r["name"] not in set(known))
    names = known + fresh
    if len(names) > limit:
        raise ValueError(f"{column}: more than {limit} names; raise the limit if as many columns are wanted")
    if fresh:
        table = spark.createDataFrame(list(enumerate(names)), SCHEMA)
        version = len(known) + 1                       # grows with every version; a lost race keeps one whole version
        table.coalesce(1).write.mode("append").parquet(f"{path}/version={version}/run={uuid.uuid4().hex}")
    return names
