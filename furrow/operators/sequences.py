"""Sequence-model inputs.

* ``sequence_windows``: for every row, the feature vectors of the previous
  ``length`` rows of its series (rows, not weeks), built with one window
  ``collect_list`` — bounded by ``length`` per row, never a whole group.
* ``fold_scalers``: per fold, feature mean and population standard
  deviation computed on that fold's training years only (no test leakage),
  from yearly counts, means and centred sums of squares that are merged.
* ``standardize``: rows of each fold scaled with that fold's scaler.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow import config as K
from furrow.operators.linreg import CONSTANT


def sequence_windows(df: DataFrame, keys: Sequence[str], features: Sequence[str],
                     length: int = K.SEQUENCE_LENGTH, order: str = "week_ending") -> DataFrame:
    """keys, order, seq (array of ``length`` feature arrays, oldest first), target rows only
    (the first ``length`` rows of a series have no full history and are dropped)."""
    keys = list(keys)
    vec = F.array(*[F.col(c).cast("double") for c in features])
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-length, -1)
    out = df.select("*", F.collect_list(F.struct(F.col(order).alias("_t"), vec.alias("_x")))
                    .over(w).alias("_hist"))
    out = out.where(F.size("_hist") == length)
    # collect_list over an ordered frame keeps frame order; sort by time anyway.
    ordered_hist = F.array_sort("_hist")
    return out.select(*[c for c in df.columns],
                      F.transform(ordered_hist, lambda s: s["_x"]).alias("seq"),
                      ordered_hist[0]["_t"].alias("seq_start"))


def fold_scalers(usable: DataFrame, keys: Sequence[str], features: Sequence[str],
                 folds: DataFrame) -> DataFrame:
    """(keys, fold, feature, n, mean, std) with std the population value (ddof 0)."""
    keys = list(keys)
    long = usable.select(*keys, "year", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features
    ])).alias("_f")).select(*keys, "year", "_f.feature", "_f.v")
    yearly = long.groupBy(*keys, "feature", "year").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("c"))
    # Years x folds rows: each fold merges the moments of its training years.
    trained = yearly.join(F.broadcast(folds), keys).where(F.col("year") < F.col("fold"))
    own = Window.partitionBy(*keys, "fold", "feature")
    trained = trained.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own))
    d = F.col("m") - F.col("mean")
    out = trained.groupBy(*keys, "fold", "feature").agg(
        F.sum("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("c") + F.col("n") * d * d).alias("c"))
    std = F.sqrt(F.col("c") / F.col("n"))
    # A spread that is only rounding of the mean is a constant feature.
    return out.withColumn("std", F.when(std > F.abs("mean") * CONSTANT, std).otherwise(F.lit(0.0))).drop("c")


def standardize(usable: DataFrame, scalers: DataFrame, keys: Sequence[str],
                features: Sequence[str]) -> DataFrame:
    """Rows of years <= fold scaled by that fold's training statistics
    (a feature with zero spread is centred only)."""
    keys = list(keys)
    sc = scalers.groupBy(*keys, "fold").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_m"))
    j = usable.join(F.broadcast(sc), keys).where(F.col("year") <= F.col("fold"))
    scaled = []
    for c in features:
        m = F.col("_m")[c]
        sd = m["std"]
        scaled.append(((F.col(c) - m["mean"]) / F.when(sd > 0, sd).otherwise(F.lit(1.0))).alias(c))
    rest = [c for c in usable.columns if c not in features]
    return j.select(*rest, "fold", *scaled,
                    (F.col("year") == F.col("fold")).cast("int").alias("is_test"))
