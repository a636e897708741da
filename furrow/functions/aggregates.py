"""Aggregate building blocks that stay distributed under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def literal_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed small table from configuration values (size known up front)."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


MEDIAN_ACCURACY = 1000


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median",
                 accuracy: int = MEDIAN_ACCURACY, margin: float | None = None) -> DataFrame:
    """Exact median per group that stays distributed when one group is huge.

    1. A mergeable quantile sketch per group (partial aggregate) gives an
       interval around the middle that holds the middle ranks: the sketch's
       rank error is at most n / ``accuracy``, the interval spans ``margin``
       (three times that) on either side.
    2. Rows above the interval are dropped before the shuffle, rows below it
       are only counted (one number per group and map task) and the interval's
       rows are counted by value, so a small part of the rows travels.
    3. A running sum over the interval's distinct values finds the middle
       ranks. Groups whose interval missed them are worked out once more over
       all their values, counted by value; where none missed, the adaptive
       planner drops that branch as empty.

    Even counts average the two middle values (the pandas / SQL median).

    Size bound: the interval table and the missed groups hold one row per group and are broadcast;
    callers group by keys whose count is set by dimensions (weeks x districts,
    models x bins), not by the number of rows.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    margin = 3.0 / accuracy if margin is None else margin
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx(F.col(value), [0.5 - margin, 0.5 + margin], accuracy).alias("_q"),
        F.count(F.lit(1)).alias("_n"))
    low = F.when(F.col(value) >= F.col("_q")[0], F.col(value))  # NULL: below the interval
    near = (rows.join(F.broadcast(bounds), keys).where(F.col(value) <= F.col("_q")[1])
                .groupBy(*keys, low.alias("_v")).agg(F.count(F.lit(1)).alias("_f"), F.first("_n").alias("_n")))
    picked = _middle(near, keys)
    missed = F.col("_a._v").isNull() | F.col("_b._v").isNull()
    again = rows.join(F.broadcast(picked.where(missed).select(*keys, "_n")), keys)
    whole = _middle(again.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_f"), F.first("_n").alias("_n")), keys)
    return picked.where(~missed).unionByName(whole).select(*keys, ((F.col("_a._v") + F.col("_b._v")) / 2.0).alias(out))


def _middle(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _a, _b, _n): the values at the two middle ranks of ``counted`` (keys, _v, _f, _n)."""
    run = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_f").over(run))

    def at(rank):
        return F.min(F.when(F.col("_cum") >= rank, F.struct("_cum", "_v")))

    return ranked.groupBy(*keys).agg(at(F.floor((F.col("_n") + 1) / 2)).alias("_a"),
                                     at(F.floor(F.col("_n") / 2) + 1).alias("_b"), F.first("_n").alias("_n"))


def weighted_mean(value: str, weight: str, cond=None, rule: str = "reference"):
    """Weighted mean of ``value`` by ``weight`` over rows meeting ``cond``.

    ``reference``: the denominator is the weight of all rows meeting ``cond``
    even where the value is missing (missing terms count as 0).
    ``clean``: the denominator only holds rows with a value.
    """
    ok = F.lit(True) if cond is None else cond
    num = F.sum(F.when(ok, F.col(weight) * F.col(value)))
    if rule == "clean":
        den = F.sum(F.when(ok & F.col(value).isNotNull(), F.col(weight)))
        return F.try_divide(num, den)
    den = F.sum(F.when(ok, F.col(weight)))
    return F.try_divide(F.coalesce(num, F.lit(0.0)), den)
