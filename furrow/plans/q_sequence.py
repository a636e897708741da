"""Sequence-model input queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import config as K
from furrow.operators import backtest as B
from furrow.operators import sequences as Q
from furrow.plans.q_models import BASE_SQL, usable_price
from furrow.plans.registry import register
from furrow.plans.spec import kinds


@register("sequence_windows", kinds("series:str week_ending:date seq_start:date seq_len:int "
                                    "first_step_price_lag1 last_step_price_lag1 seq:raw"))
def q_sequence_windows(spark, sf_dir):
    """Previous 8 rows' level-model feature vectors per target row (rows of
    the complete-case set, oldest first)."""
    u = usable_price(spark, sf_dir)
    feats = K.LEVEL_FEATURES
    s = Q.sequence_windows(u, ["series"], feats)
    i = feats.index("price_lag1")
    return s.select("series", "week_ending", "seq_start", F.size("seq").alias("seq_len"),
                    F.col("seq")[0][i].alias("first_step_price_lag1"),
                    F.col("seq")[K.SEQUENCE_LENGTH - 1][i].alias("last_step_price_lag1"), "seq")


_SCALER_SQL = BASE_SQL + """,
long AS (""" + "\n  UNION ALL ".join(
    f"SELECT series, year, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM usable"
    for c in K.LEVEL_FEATURES) + """)
SELECT f.series, f.fold, l.feature, count(l.v) AS n, avg(l.v) AS mean, stddev_pop(l.v) AS std
FROM folds f JOIN long l ON l.series = f.series AND l.year < f.fold
GROUP BY 1, 2, 3"""


@register("fold_scalers", kinds("series:str fold:int feature:str n:int mean std"), _SCALER_SQL)
def q_fold_scalers(spark, sf_dir):
    """Per fold, feature mean / population sd from training years only."""
    u = usable_price(spark, sf_dir)
    folds = B.fold_table(u, ["series"])
    return Q.fold_scalers(u, ["series"], K.LEVEL_FEATURES, folds)


_STD_SQL = _SCALER_SQL.replace("SELECT f.series, f.fold, l.feature", ",\nsc AS (\nSELECT f.series, f.fold, l.feature", 1) + """)
SELECT u.series, f.fold, u.year, CASE WHEN u.year = f.fold THEN 1 ELSE 0 END AS is_test,
       count(*) AS rows,
       avg((u.price_lag1 - a.mean) / CASE WHEN a.std > 0 THEN a.std ELSE 1.0 END) AS mean_price_lag1,
       avg((u.volume_lag1 - b.mean) / CASE WHEN b.std > 0 THEN b.std ELSE 1.0 END) AS mean_volume_lag1
FROM usable u JOIN folds f ON u.series = f.series AND u.year <= f.fold
JOIN sc a ON a.series = f.series AND a.fold = f.fold AND a.feature = 'price_lag1'
JOIN sc b ON b.series = f.series AND b.fold = f.fold AND b.feature = 'volume_lag1'
GROUP BY 1, 2, 3, 4"""


@register("standardized_folds", kinds("series:str fold:int year:int is_test:int rows:int "
                                      "mean_price_lag1 mean_volume_lag1"), _STD_SQL)
def q_standardized(spark, sf_dir):
    """Rows of every fold scaled with that fold's train-only scaler; per
    (fold, year) the row count and the mean of two scaled features."""
    u = usable_price(spark, sf_dir)
    folds = B.fold_table(u, ["series"])
    sc = Q.fold_scalers(u, ["series"], K.LEVEL_FEATURES, folds)
    z = Q.standardize(u, sc, ["series"], K.LEVEL_FEATURES)
    return z.groupBy("series", "fold", "year", "is_test").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("price_lag1").alias("mean_price_lag1"),
        F.avg("volume_lag1").alias("mean_volume_lag1"))


_SEQ_SQL = BASE_SQL + f"""
SELECT * FROM (
  SELECT series, week_ending,
         lag(week_ending, {K.SEQUENCE_LENGTH}) OVER w AS seq_start,
         CASE WHEN lag(week_ending, {K.SEQUENCE_LENGTH}) OVER w IS NOT NULL
              THEN {K.SEQUENCE_LENGTH} END AS seq_len,
         lag(price_lag1, {K.SEQUENCE_LENGTH}) OVER w AS first_step_price_lag1,
         lag(price_lag1, 1) OVER w AS last_step_price_lag1
  FROM usable WINDOW w AS (PARTITION BY series ORDER BY week_ending))
WHERE seq_start IS NOT NULL"""


@register("sequence_window_bounds", kinds("series:str week_ending:date seq_start:date seq_len:int "
                                          "first_step_price_lag1 last_step_price_lag1"), _SEQ_SQL)
def q_sequence_bounds(spark, sf_dir):
    """The same windows as ``sequence_windows`` reduced to their bounds
    (first week, length, first and last step of one feature)."""
    return q_sequence_windows(spark, sf_dir).drop("seq")


_STEPS_SQL = BASE_SQL + """,
long AS (""" + "\n  UNION ALL ".join(
    f"SELECT series, week_ending, {i} AS feature, CAST({c} AS DOUBLE) AS v FROM usable" for i, c in enumerate(K.LEVEL_FEATURES)) + f"""),
steps AS (SELECT l.series, l.week_ending, l.feature, s.step, lag(l.v, {K.SEQUENCE_LENGTH} - s.step) OVER w AS value,
                 lag(l.week_ending, {K.SEQUENCE_LENGTH}) OVER w AS seq_start
          FROM long l, (SELECT unnest(range(0, {K.SEQUENCE_LENGTH})) AS step) s
          WINDOW w AS (PARTITION BY l.series, l.feature, s.step ORDER BY l.week_ending))
SELECT series, week_ending, step, feature, value FROM steps WHERE seq_start IS NOT NULL"""


@register("sequence_steps", kinds("series:str week_ending:date step:int feature:int value"), _STEPS_SQL)
def q_sequence_steps(spark, sf_dir):
    """The whole arrays of ``sequence_windows``, one row a target, step and feature."""
    s = q_sequence_windows(spark, sf_dir)
    steps = s.select("series", "week_ending", F.posexplode("seq").alias("step", "x"))
    return steps.select("series", "week_ending", "step", F.posexplode("x").alias("feature", "value"))
