"""Missing-price imputation.

Train on district-weeks with an observed price and positive volume, predict
district-weeks with volume but no price. Features: weather, volume history,
one dummy per district, season and calendar — no price lags. With an
intercept plus a dummy for every district the OLS design is exactly
collinear; the rank-safe solve handles it (predictions are unaffected).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import AnalysisConfig
from furrow.functions.columns import flag, month_in, zero_to_null
from furrow.functions.windows import ordered, rolling_mean, trailing
from furrow.operators import backtest as B
from furrow.operators import trees as TR

WEATHER_COLS = ["tmax_avg", "tmin_avg", "tmax_max", "tmin_min", "ppt_total", "ppt_days",
                "tmean_avg", "diurnal_range", "extreme_heat", "freeze_risk", "heavy_rain",
                "dd_heat", "dd_freeze"]


def dummy_name(district: str) -> str:
    return "d_" + re.sub(r"[\s\-]+", "_", district.strip().lower())


def imputation_frame(panel: DataFrame, cfg: AnalysisConfig, series: str | None = None) -> DataFrame:
    """All districts' rows of one series with lags, rolls, dummies and quarters."""
    s = series or cfg.main_series
    sfx = cfg.suffix(s)
    df = panel.select(
        F.lit(s).alias("series"), "week_ending", "district", "state",
        F.coalesce(F.col(f"vol_{sfx}"), F.lit(0.0)).alias("volume"),
        zero_to_null(f"price_{sfx}").alias("price"),
        *WEATHER_COLS, "year", "month", "week_of_year")
    # The district list is a dimension (a handful of names), not data-sized.
    districts = sorted(r[0] for r in panel.select("district").distinct().collect())
    w = ordered(["series", "district"], "week_ending")
    roll_rows, roll_need = K.ROLL_WINDOW
    w4 = trailing(["series", "district"], "week_ending", roll_rows)
    return df.select(
        "*",
        *[flag(F.col("district") == d).alias(dummy_name(d)) for d in districts],
        *[month_in("month", m).alias(q) for q, m in K.QUARTER_MONTHS.items()],
        F.lag("volume", 1).over(w).alias("volume_lag1"),
        F.lag("volume", 2).over(w).alias("volume_lag2"),
        rolling_mean("volume", w4, roll_need).alias("volume_roll4"),
        F.lag("tmax_avg", 1).over(w).alias("tmax_lag1"),
        F.lag("ppt_total", 1).over(w).alias("ppt_lag1"),
    )


def features(frame: DataFrame) -> list[str]:
    dummies = sorted(c for c in frame.columns if c.startswith("d_"))
    return K.IMPUTE_WEATHER + K.IMPUTE_VOLUME + dummies + K.IMPUTE_SEASON


def split(frame: DataFrame, feats: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(observed, missing): both need volume > 0 and every feature present."""
    feats = list(feats) if feats is not None else features(frame)
    pos = F.col("volume") > 0
    observed = frame.where(F.col("price").isNotNull() & pos).na.drop(subset=feats)
    missing = frame.where(F.col("price").isNull() & pos).na.drop(subset=feats)
    return observed, missing


def _specs(frame: DataFrame):
    feats = tuple(features(frame))
    ols = B.ModelSpec("OLS impute", feats, "price")
    boost = B.ModelSpec("Boosted impute", feats, "price", "boost",
                        params=tuple(sorted(K.BOOST_IMPUTE.items())))
    return ols, boost


def imputation_backtest(spark: SparkSession, frame: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Per test year, OLS and boosted RMSE/MAE on observed prices."""
    observed, _ = split(frame)
    ols, boost = _specs(frame)
    cols = ["series", "model", "year", "week_ending", "coverage", "pred_level", "actual"]
    obs = observed.withColumn("coverage", F.lit(None).cast("double"))
    p_ols = B.ols_backtest(obs, [ols], extra=("week_ending", "price", "coverage")).select(cols)
    p_boost = TR.tree_backtest(spark, obs, [boost]).select(cols)
    s = B.score(p_ols.unionByName(p_boost), ["series", "model"])
    a = s.where(F.col("model") == ols.name).select(
        "series", "year", "n", F.col("rmse").alias("ols_rmse"), F.col("mae").alias("ols_mae"))
    b = s.where(F.col("model") == boost.name).select(
        "series", "year", F.col("rmse").alias("boost_rmse"), F.col("mae").alias("boost_mae"))
    return a.join(b, ["series", "year"], "full")


def impute_missing(spark: SparkSession, frame: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Fit boosted trees on all observed rows, predict the missing ones, clip at 0."""
    observed, missing = split(frame)
    _, boost = _specs(frame)
    model = TR.fit_model(TR.materialize(TR.dealt(observed)), boost)
    va_in = missing.withColumn("price", F.lit(0.0))  # label column is not used by predict
    pred = model.transform(TR._assemble(va_in, boost))
    return pred.select("series", "week_ending", "district", "volume",
                       F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted_price"))


def compare_by_district(predicted: DataFrame, frame: DataFrame,
                        feats: list[str] | None = None) -> DataFrame:
    """Predicted mean vs observed mean price per district (left: predicted districts)."""
    observed, _ = split(frame, feats)
    p = predicted.groupBy("series", "district").agg(
        F.count(F.lit(1)).alias("n_predicted"), F.avg("predicted_price").alias("predicted_mean"))
    o = observed.groupBy("series", "district").agg(F.avg("price").alias("observed_mean"))
    return p.join(o, ["series", "district"], "left")


def impute_missing_ols(frame: DataFrame, feats: list[str]) -> DataFrame:
    """M14 with least squares: fit on all observed rows (per series, from the
    distributed Gram), predict the missing rows, clip at 0."""
    from furrow.operators import linreg
    observed, missing = split(frame, feats)
    x = F.array(*[F.col(c).cast("double") for c in feats])
    design = observed.select("series", x.alias("x"), F.col("price").cast("double").alias("y"))
    coefs = linreg.least_squares(design, ["series"])
    rows = missing.select("series", "week_ending", "district", "volume", x.alias("x"))
    pred = linreg.predict(rows, coefs, ["series"])
    return pred.select("series", "week_ending", "district", "volume",
                       F.greatest(F.col("pred"), F.lit(0.0)).alias("predicted_price"))
