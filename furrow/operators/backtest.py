"""Back-testing: folds, model registry, OLS over all folds, scores, leaderboard.

Instead of refitting every model once per test year from raw rows, the usable
rows are read once: centred moments of the union of all models' columns per
(series, year) are merged into those of each fold's training years, every model
takes its columns of the merged matrix, and predictions are a JVM-side dot
product against broadcast coefficients (one row per model and fold).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow import config as K
from furrow.functions.columns import safe_log
from furrow.operators import linreg


@dataclass(frozen=True)
class ModelSpec:
    name: str
    features: tuple[str, ...]
    target: str  # price | dprice | log_dprice | volume | dvolume
    method: str = "ols"  # ols | boost | forest
    back: str = "level"  # level | diff | logdiff
    params: tuple = ()

    @property
    def param_dict(self) -> dict:
        return dict(self.params)


def _p(d: dict) -> tuple:
    return tuple(sorted(d.items()))


# The eleven price models of the comparison grid (M8).
PRICE_MODELS = [
    ModelSpec("OLS Level (full)", tuple(K.LEVEL_FEATURES), "price"),
    ModelSpec("OLS Level (no lags)", tuple(K.CHANGE_FEATURES), "price"),
    ModelSpec("Boosted Level (full)", tuple(K.LEVEL_FEATURES), "price", "boost", params=_p(K.BOOST_CONSERVATIVE)),
    ModelSpec("Boosted Level (no lags)", tuple(K.CHANGE_FEATURES), "price", "boost", params=_p(K.BOOST_CONSERVATIVE)),
    ModelSpec("RF Level (full)", tuple(K.LEVEL_FEATURES), "price", "forest", params=_p(K.FOREST)),
    ModelSpec("RF Level (no lags)", tuple(K.CHANGE_FEATURES), "price", "forest", params=_p(K.FOREST)),
    ModelSpec("OLS Δprice", tuple(K.CHANGE_FEATURES), "dprice", back="diff"),
    ModelSpec("Boosted Δprice", tuple(K.CHANGE_FEATURES), "dprice", "boost", "diff", _p(K.BOOST_CONSERVATIVE)),
    ModelSpec("RF Δprice", tuple(K.CHANGE_FEATURES), "dprice", "forest", "diff", _p(K.FOREST)),
    ModelSpec("OLS log Δprice", tuple(K.CHANGE_FEATURES), "log_dprice", back="logdiff"),
    ModelSpec("Boosted log Δprice", tuple(K.CHANGE_FEATURES), "log_dprice", "boost", "logdiff", _p(K.BOOST_CONSERVATIVE)),
]

# Extreme-weather specification comparison (M17): indicators vs degree days.
_BASE_NO_EXTREME = [c for c in K.LEVEL_FEATURES if c not in ("dd_heat", "dd_freeze", "heavy_rain")]
_CHG_NO_EXTREME = [c for c in K.CHANGE_FEATURES if c not in ("dd_heat", "dd_freeze", "heavy_rain")]
_IND = ["extreme_heat", "freeze_risk", "heavy_rain"]
_DD = ["dd_heat", "dd_freeze"]
EXTREME_SPECS = [
    ModelSpec("Level (indicators)", tuple(_BASE_NO_EXTREME + _IND), "price"),
    ModelSpec("Level (degree days)", tuple(_BASE_NO_EXTREME + _DD), "price"),
    ModelSpec("Level (both)", tuple(_BASE_NO_EXTREME + _IND + _DD), "price"),
    ModelSpec("Change (indicators)", tuple(_CHG_NO_EXTREME + _IND), "dprice", back="diff"),
    ModelSpec("Change (degree days)", tuple(_CHG_NO_EXTREME + _DD), "dprice", back="diff"),
    ModelSpec("Change (both)", tuple(_CHG_NO_EXTREME + _IND + _DD), "dprice", back="diff"),
]

VOLUME_MODELS = [
    ModelSpec("OLS Level", tuple(K.VOLUME_LEVEL_FEATURES), "volume"),
    ModelSpec("Boosted Level", tuple(K.VOLUME_LEVEL_FEATURES), "volume", "boost", params=_p(K.BOOST_CONSERVATIVE)),
    ModelSpec("OLS Δvolume", tuple(K.VOLUME_CHANGE_FEATURES), "dvolume", back="vdiff"),
    ModelSpec("Boosted Δvolume", tuple(K.VOLUME_CHANGE_FEATURES), "dvolume", "boost", "vdiff", _p(K.BOOST_CONSERVATIVE)),
]


def add_targets(m: DataFrame) -> DataFrame:
    """Δprice, log Δprice and Δvolume (first differences against lag 1)."""
    return m.select(
        "*",
        (F.col("price") - F.col("price_lag1")).alias("dprice"),
        (safe_log("price") - safe_log("price_lag1")).alias("log_dprice"),
        (F.col("volume") - F.col("volume_lag1")).alias("dvolume"),
    )


def actual_col(spec: ModelSpec) -> str:
    return "volume" if spec.target in ("volume", "dvolume") else "price"


def back_transform(spec: ModelSpec, pred: Column) -> Column:
    """Scores are always in levels: change models add back the last level."""
    if spec.back == "diff":
        return F.col("price_lag1") + pred
    if spec.back == "logdiff":
        return F.exp(F.ln(F.col("price_lag1")) + pred)
    if spec.back == "vdiff":
        return F.col("volume_lag1") + pred
    return pred


def complete_cases(m: DataFrame, specs: Sequence[ModelSpec], extra: Sequence[str] = ()) -> DataFrame:
    """One shared set of rows for every model: all used columns present."""
    cols = set(extra)
    for s in specs:
        cols.update(s.features)
        cols.add(s.target)
        cols.add(actual_col(s))
        if s.back in ("diff", "logdiff"):
            cols.add("price_lag1")
        if s.back == "vdiff":
            cols.add("volume_lag1")
    return m.na.drop(subset=sorted(cols))


def fold_table(usable: DataFrame, keys: Sequence[str], min_train: int = K.MIN_TRAIN_YEARS) -> DataFrame:
    """Test years per group: every distinct usable year after the first ``min_train``.

    The input is reduced to distinct (keys, year) before the window, so the
    window sorts at most (#groups x #years) rows.
    """
    years = usable.select(*keys, "year").distinct()
    w = Window.partitionBy(*keys).orderBy("year")
    return (years.withColumn("_r", F.dense_rank().over(w))
                 .where(F.col("_r") > min_train).select(*keys, F.col("year").alias("fold")))


def design_rows(usable: DataFrame, specs: Sequence[ModelSpec], keys: Sequence[str],
                extra: Sequence[str] = ()) -> DataFrame:
    """Union of per-model design rows: keys, model, year, x, y, extra."""
    parts = []
    for s in specs:
        x = F.array(*[F.col(c).cast("double") for c in s.features])
        parts.append(usable.select(*keys, F.lit(s.name).alias("model"), "year", x.alias("x"),
                                   F.col(s.target).cast("double").alias("y"), *extra))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ols_backtest(usable: DataFrame, specs: Sequence[ModelSpec], keys: Sequence[str] = ("series",),
                 mode: str = "expanding", window_years: int = K.ROLLING_YEARS,
                 min_train: int = K.MIN_TRAIN_YEARS, min_train_rows: int = 0,
                 extra: Sequence[str] = ("week_ending", "price", "price_lag1", "volume",
                                         "volume_lag1", "coverage")) -> DataFrame:
    """Out-of-sample predictions of every OLS spec at every fold.

    Returns keys, model, year (= fold), extra columns, pred (in target units),
    pred_level and actual (in levels), n_train.
    """
    keys = list(keys)
    specs = [s for s in specs if s.method == "ols"]
    columns = sorted({c for s in specs for c in (*s.features, s.target)})
    place = {c: i for i, c in enumerate(columns)}
    rows = usable.select(*keys, "year", F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))
    folds = fold_table(usable, keys, min_train)
    models = [(s.name, [place[c] for c in s.features], place[s.target]) for s in specs]
    coefs = linreg.solve_folds(linreg.moments(rows, keys + ["year"]), keys, folds, models, mode, window_years)
    if min_train_rows:
        coefs = coefs.where(F.col("n") >= min_train_rows)
    # Coefficients: one row per (model, fold) — bounded by registry x years. The test rows
    # meet those of their year; a model's own columns are picked by its name.
    cf = coefs.select(*keys, "model", F.col("fold").alias("year"), "beta", F.col("n").alias("n_train"))
    names = [c for c in extra if c not in keys]
    pred = usable.join(F.broadcast(cf), keys + ["year"])
    level, actual, x = (F.lit(None).cast(t) for t in ("double", "double", "array<double>"))
    for s in specs:
        own = F.col("model") == s.name
        x = F.when(own, F.array(*(F.col(c).cast("double") for c in s.features))).otherwise(x)
        level = F.when(own, back_transform(s, F.col("pred"))).otherwise(level)
        actual = F.when(own, F.col(actual_col(s))).otherwise(actual)
    pred = pred.withColumn("x", x).withColumn("pred", linreg.linear_predict())
    return pred.select(*keys, "model", "year", *names, "pred", level.alias("pred_level"), actual.alias("actual"), "n_train")


def naive_predictions(usable: DataFrame, keys: Sequence[str] = ("series",), target: str = "price",
                      min_train: int = K.MIN_TRAIN_YEARS, name: str = "Naive (price=lag1)",
                      extra: Sequence[str] = ("coverage",)) -> DataFrame:
    """Last week's value as the forecast (F3), on the test years only."""
    folds = fold_table(usable, keys, min_train).withColumnRenamed("fold", "year")
    t = usable.join(F.broadcast(folds), list(keys) + ["year"])
    return t.select(*keys, F.lit(name).alias("model"), "year", "week_ending", *extra,
                    F.col(f"{target}_lag1").alias("pred_level"), F.col(target).alias("actual"))


def score(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, year): n, RMSE and MAE of level predictions."""
    e = F.col("actual") - F.col("pred_level")
    return preds.groupBy(*keys, "year").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    )


def leaderboard(scores: DataFrame, keys: Sequence[str], naive_model: str) -> DataFrame:
    """Plain mean of yearly RMSE/MAE per model and the gain over the naive model."""
    keys = list(keys)
    base = [k for k in keys if k != "model"]
    avg = scores.groupBy(*keys).agg(F.avg("rmse").alias("avg_rmse"), F.avg("mae").alias("avg_mae"),
                                    F.count(F.lit(1)).alias("n_folds"))
    if not base:  # single board: join on a constant key (one naive row)
        avg, base = avg.withColumn("_all", F.lit(1)), ["_all"]
    naive = avg.where(F.col("model") == naive_model).select(*base, F.col("avg_rmse").alias("_nv"))
    out = avg.join(F.broadcast(naive), base, "left")
    return out.select(*keys, "avg_rmse", "avg_mae", "n_folds",
                      (F.try_divide(F.col("_nv") - F.col("avg_rmse"), F.col("_nv")) * 100)
                      .alias("vs_naive_pct"))


def period_label(periods: Sequence[tuple[str, int, int]]) -> Column:
    """Name of the period (name, first year, last year) that the row's year lies in."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(list(periods)):
        label = F.when(F.col("year").between(low, high), F.lit(name)).otherwise(label)
    return label


def period_coefficients(usable: DataFrame, features: Sequence[str], target: str, periods: Sequence[tuple[str, int, int]],
                        keys: Sequence[str] = ("series",), min_rows: int = K.PERIOD_MIN_ROWS) -> DataFrame:
    """(keys, period, n, idx, term, coef): least squares of each period of ``min_rows`` rows or more."""
    rows = usable.withColumn("period", period_label(periods)).where(F.col("period").isNotNull())
    design = rows.select(*keys, "period", F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                         F.col(target).cast("double").alias("y"))
    coefs = linreg.least_squares(design, [*keys, "period"]).where(F.col("n") >= min_rows)
    names = F.array(*[F.lit(t) for t in ["const", *features]])
    return coefs.select(*keys, "period", "n", F.posexplode("beta").alias("idx", "coef")).withColumn("term", names[F.col("idx")])
