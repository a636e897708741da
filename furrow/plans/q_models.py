"""Back-test, OLS and diagnostics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import DRIVER as CFG
from furrow.operators import backtest as B
from furrow.operators import evaluate as E
from furrow.operators import market
from furrow.plans import ols_sql as Q
from furrow.plans import oracle as O
from furrow.plans.q_panel import build_panel
from furrow.plans.registry import register
from furrow.plans.spec import kinds
from furrow.session import materialize

NAIVE = "Naive (price=lag1)"


def market_main(spark, sf_dir):
    """Main-series market set with targets. It feeds many branches of a model
    query (designs, folds, test rows), so its lineage is cut once with a
    checkpoint in the session's checkpoint folder."""
    return materialize(B.add_targets(market.market_series(build_panel(spark, sf_dir), CFG)))


def usable_price(spark, sf_dir):
    """The shared complete-case rows of the price model grid."""
    return B.complete_cases(market_main(spark, sf_dir), B.PRICE_MODELS,
                            extra=["price_lag1", "dprice", "log_dprice"])


# ------------------------------------------------------------------ SQL

def _usable_cols():
    cols = set(K.LEVEL_FEATURES) | set(K.CHANGE_FEATURES) | {"price", "price_lag1", "dprice",
                                                             "log_dprice"}
    return sorted(cols)


BASE_SQL = ("WITH RECURSIVE " + O.panel_cte().lstrip() + O.market_cte() + """,
mk AS (
  SELECT *, price - price_lag1 AS dprice,
         CASE WHEN price > 0 AND price_lag1 > 0 THEN ln(price) - ln(price_lag1) END AS log_dprice,
         volume - volume_lag1 AS dvolume
  FROM market),
usable AS (SELECT * FROM mk WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in _usable_cols()) + """),
folds AS (
  SELECT series, year AS fold FROM (
    SELECT series, year, dense_rank() OVER (PARTITION BY series ORDER BY year) AS r
    FROM (SELECT DISTINCT series, year FROM usable)) WHERE r > """ + str(K.MIN_TRAIN_YEARS) + """),
naive AS (
  SELECT u.series, '""" + NAIVE + """' AS model, u.year, u.week_ending, u.coverage,
         u.price_lag1 AS pred_level, u.price AS actual
  FROM usable u JOIN folds f ON u.series = f.series AND u.year = f.fold),
naive_tbl AS (
  SELECT series, model, year, week_ending, actual, pred_level AS predicted, coverage,
         abs(actual - pred_level) AS abs_error,
         abs(actual - pred_level) / actual * 100 AS pct_error,
         actual - pred_level AS signed_error
  FROM naive)""")

SCORE_COLS = kinds("series:str model:str year:int n:int rmse mae")


def _score_sql(src: str) -> str:
    return (f"SELECT series, model, year, count(*) AS n, "
            f"sqrt(avg((actual - pred_level) * (actual - pred_level))) AS rmse, "
            f"avg(abs(actual - pred_level)) AS mae FROM {src} GROUP BY 1, 2, 3")


# -------------------------------------------------------------- queries

@register("fold_table", kinds("series:str fold:int"), BASE_SQL + "\nSELECT * FROM folds")
def q_fold_table(spark, sf_dir):
    """expanding-window test years (every usable year after the first four)."""
    return B.fold_table(usable_price(spark, sf_dir), ["series"])


@register("naive_scores", SCORE_COLS, BASE_SQL + "\n" + _score_sql("naive"))
def q_naive_scores(spark, sf_dir):
    """naive forecast (price = last week's price), RMSE/MAE per test year."""
    return B.score(B.naive_predictions(usable_price(spark, sf_dir)), ["series", "model"])


OLS1 = B.ModelSpec("OLS price~lag1", ("price_lag1",), "price")
OLS2 = B.ModelSpec("OLS price~lag1+vol", ("price_lag1", "volume_lag1"), "price")

_OLS1_SQL = BASE_SQL + """,
fit AS (
  SELECT f.series, f.fold, regr_slope(u.price, u.price_lag1) AS b1,
         regr_intercept(u.price, u.price_lag1) AS b0
  FROM folds f JOIN usable u ON u.series = f.series AND u.year < f.fold GROUP BY 1, 2),
pred AS (
  SELECT u.series, 'OLS price~lag1' AS model, u.year, u.price AS actual,
         fit.b0 + fit.b1 * u.price_lag1 AS pred_level
  FROM usable u JOIN fit ON u.series = fit.series AND u.year = fit.fold)
""" + _score_sql("pred")


@register("ols1_backtest", SCORE_COLS, _OLS1_SQL)
def q_ols1_backtest(spark, sf_dir):
    """M1+M2+F4: one-regressor OLS refitted for every expanding fold from yearly Grams."""
    p = B.ols_backtest(usable_price(spark, sf_dir), [OLS1])
    return B.score(p, ["series", "model"])


_OLS2_SQL = BASE_SQL + """,
mom AS (
  SELECT f.series, f.fold, avg(u.price) AS my, avg(u.price_lag1) AS m1, avg(u.volume_lag1) AS m2,
         var_pop(u.price_lag1) AS c11, var_pop(u.volume_lag1) AS c22,
         covar_pop(u.price_lag1, u.volume_lag1) AS c12,
         covar_pop(u.price_lag1, u.price) AS c1y, covar_pop(u.volume_lag1, u.price) AS c2y
  FROM folds f JOIN usable u ON u.series = f.series AND u.year < f.fold GROUP BY 1, 2),
fit AS (
  SELECT series, fold,
         (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1,
         (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2, my, m1, m2
  FROM mom),
pred AS (
  SELECT u.series, 'OLS price~lag1+vol' AS model, u.year, u.price AS actual,
         fit.my - fit.b1 * fit.m1 - fit.b2 * fit.m2 + fit.b1 * u.price_lag1
           + fit.b2 * u.volume_lag1 AS pred_level
  FROM usable u JOIN fit ON u.series = fit.series AND u.year = fit.fold)
""" + _score_sql("pred")


@register("ols2_backtest", SCORE_COLS, _OLS2_SQL)
def q_ols2_backtest(spark, sf_dir):
    """M1+M2: two-regressor OLS per expanding fold (normal equations in the oracle)."""
    p = B.ols_backtest(usable_price(spark, sf_dir), [OLS2])
    return B.score(p, ["series", "model"])


_ROLL_SQL = BASE_SQL + f""",
fit AS (
  SELECT f.series, f.fold, regr_slope(u.price, u.price_lag1) AS b1,
         regr_intercept(u.price, u.price_lag1) AS b0, count(*) AS n_train
  FROM folds f JOIN usable u ON u.series = f.series
       AND u.year >= f.fold - {K.ROLLING_YEARS} AND u.year < f.fold
  GROUP BY 1, 2 HAVING count(*) >= 2),
pred AS (
  SELECT u.series, 'OLS price~lag1' AS model, u.year, u.price AS actual,
         fit.b0 + fit.b1 * u.price_lag1 AS pred_level
  FROM usable u JOIN fit ON u.series = fit.series AND u.year = fit.fold)
""" + _score_sql("pred")


@register("ols1_rolling_backtest", SCORE_COLS, _ROLL_SQL)
def q_ols1_rolling(spark, sf_dir):
    """rolling five-year training window (window over years of the yearly Grams)."""
    p = B.ols_backtest(usable_price(spark, sf_dir), [OLS1], mode="rolling", min_train_rows=2)
    return B.score(p, ["series", "model"])


COV_COLS = kinds("series:str model:str coverage_bin:str bin_order:int n:int mae mape median_error")


@register("naive_error_by_coverage", COV_COLS, BASE_SQL + "\n" + """
SELECT series, model, coverage_bin, bin_order, count(*) AS n, avg(abs_error) AS mae,
       avg(pct_error) AS mape, median(abs_error) AS median_error
FROM (SELECT *, """ + "CASE " + " ".join(
    f"WHEN coverage >= {lo} AND coverage < {hi} THEN '{lab}'" for lo, hi, lab in K.COVERAGE_BINS)
    + " END AS coverage_bin, CASE " + " ".join(
    f"WHEN coverage >= {lo} AND coverage < {hi} THEN {i}" for i, (lo, hi, lab) in enumerate(K.COVERAGE_BINS))
    + """ END AS bin_order FROM naive_tbl)
WHERE coverage_bin IS NOT NULL GROUP BY 1, 2, 3, 4""")
def q_naive_cov(spark, sf_dir):
    """F7+F8: error by coverage bin ([lo, hi) edges), exact median, on naive forecasts."""
    t = E.prediction_table(B.naive_predictions(usable_price(spark, sf_dir)), ["series", "model"])
    return E.error_by_coverage(t, ["series", "model"])


PERIOD_COLS = kinds("series:str model:str period:str n:int rmse mae mape")


@register("naive_period_errors", PERIOD_COLS, BASE_SQL + f"""
SELECT series, model, period, count(*) AS n, sqrt(avg(abs_error * abs_error)) AS rmse,
       avg(abs_error) AS mae, avg(pct_error) AS mape
FROM (SELECT *, CASE WHEN year <= {CFG.early_last_year} THEN '<= {CFG.early_last_year}'
                     ELSE '>= {CFG.early_last_year + 1}' END AS period FROM naive_tbl
      UNION ALL SELECT *, 'All' AS period FROM naive_tbl)
GROUP BY 1, 2, 3""")
def q_naive_period(spark, sf_dir):
    """early / late / all RMSE, MAE, MAPE of the naive forecasts."""
    t = E.prediction_table(B.naive_predictions(usable_price(spark, sf_dir)), ["series", "model"])
    return E.period_errors(t, ["series", "model"], CFG.early_last_year)


@register("naive_partial_year", kinds("series:str model:str n_partial:int mae_partial mape_partial "
                                      "rmse_with rmse_without negligible:int"),
          BASE_SQL + f"""
SELECT series, model, count(*) FILTER (WHERE year = {CFG.partial_year}) AS n_partial,
       avg(CASE WHEN year = {CFG.partial_year} THEN abs_error END) AS mae_partial,
       avg(CASE WHEN year = {CFG.partial_year} THEN pct_error END) AS mape_partial,
       sqrt(avg(abs_error * abs_error)) AS rmse_with,
       sqrt(avg(CASE WHEN year <> {CFG.partial_year} THEN abs_error * abs_error END)) AS rmse_without,
       CASE WHEN abs(sqrt(avg(abs_error * abs_error))
                     - sqrt(avg(CASE WHEN year <> {CFG.partial_year} THEN abs_error * abs_error END)))
                 < 0.1 THEN 1 ELSE 0 END AS negligible
FROM naive_tbl GROUP BY 1, 2""")
def q_naive_partial(spark, sf_dir):
    """partial-year sensitivity of the overall RMSE."""
    t = E.prediction_table(B.naive_predictions(usable_price(spark, sf_dir)), ["series", "model"])
    return E.partial_year_sensitivity(t, ["series", "model"], CFG.partial_year)


@register("naive_extreme_year", kinds("series:str model:str period:str n:int mae max_error"),
          BASE_SQL + f"""
SELECT series, model, CASE WHEN year = {CFG.extreme_year} THEN '{CFG.extreme_year}' ELSE 'other' END
       AS period, count(*) AS n, avg(abs_error) AS mae, max(abs_error) AS max_error
FROM naive_tbl GROUP BY 1, 2, 3""")
def q_naive_extreme(spark, sf_dir):
    """one extreme year against the others."""
    t = E.prediction_table(B.naive_predictions(usable_price(spark, sf_dir)), ["series", "model"])
    return E.extreme_year_split(t, ["series", "model"], CFG.extreme_year)


@register("extreme_year_prices", kinds("series:str price_mean price_max price_std price_spikes:int"),
          BASE_SQL + f"""
SELECT series, avg(price) AS price_mean, max(price) AS price_max, stddev_samp(price) AS price_std,
       sum(price_spike) AS price_spikes FROM market WHERE year = {CFG.extreme_year} GROUP BY 1""")
def q_extreme_prices(spark, sf_dir):
    """price mean / max / std / spike count of the extreme year."""
    return E.year_price_profile(market_main(spark, sf_dir), ["series"], CFG.extreme_year)


@register("volatile_years", kinds("series:str year:int price_mean price_max price_std rank:int"),
          BASE_SQL + """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY price_std DESC NULLS LAST, year) AS rank
  FROM (SELECT series, year, avg(price) AS price_mean, max(price) AS price_max,
               stddev_samp(price) AS price_std FROM market GROUP BY 1, 2))
WHERE rank <= 5""")
def q_volatile_years(spark, sf_dir):
    """The five most volatile years (price std) with mean and max."""
    return E.volatile_years(market_main(spark, sf_dir), ["series"], 5)


# ----------------------------------------------------- many regressors

def _back_sql(spec: B.ModelSpec, pred: str) -> str:
    return {"level": pred, "diff": f"price_lag1 + {pred}", "logdiff": f"exp(ln(price_lag1) + {pred})",
            "vdiff": f"volume_lag1 + {pred}"}[spec.back]


def ols_preds_sql(base: str, source: str, specs, own=None, rolling: bool = False, keep: str = "price_lag1, volume_lag1, coverage, week_ending") -> str:
    """``base`` and CTE ``preds`` (series, model, year, actual, pred_level, ...): every OLS spec
    refitted for each test year of ``source``'s complete cases in the columns ``own``."""
    specs = [s for s in specs if s.method == "ols"]
    full = " AND ".join(f"{c} IS NOT NULL" for c in own) if own else "TRUE"
    before = f"u.year < f.fold AND u.year >= f.fold - {K.ROLLING_YEARS}" if rolling else "u.year < f.fold"
    rows, tests, preds = [], [], []
    for k, s in enumerate(specs):
        x = ", ".join(f"CAST(u.{c} AS DOUBLE)" for c in s.features)
        rows.append(f"SELECT u.series || '|{s.name}|' || f.fold AS g, row_number() OVER () AS rid, CAST(u.{s.target} AS DOUBLE) AS y, "
                    f"[{x}] AS x FROM cases u JOIN case_folds f ON u.series = f.series AND {before}")
        tests.append(f"test{k} AS (SELECT u.*, [{x}] AS x FROM cases u JOIN case_folds f ON u.series = f.series AND u.year = f.fold)")
        preds.append(f"SELECT u.series, '{s.name}' AS model, u.year, u.{B.actual_col(s)} AS actual, n.n AS n_train, "
                     f"{_back_sql(s, '(' + Q.predicted('b', 'u.x') + ')')} AS pred_level, {keep} FROM test{k} u "
                     f"JOIN f_beta b ON b.g = u.series || '|{s.name}|' || u.year JOIN f_n n ON n.g = b.g")
    return f"""{base},
cases AS (SELECT * FROM {source} WHERE {full}),
case_folds AS (
  SELECT series, year AS fold FROM (
    SELECT series, year, dense_rank() OVER (PARTITION BY series ORDER BY year) AS r
    FROM (SELECT DISTINCT series, year FROM cases)) WHERE r > {K.MIN_TRAIN_YEARS}),
fitrows AS ({" UNION ALL ".join(rows)}),{Q.fit_ctes("f", "fitrows")},
{", ".join(tests)},
preds AS ({" UNION ALL ".join(preds)})
"""


def ols_scores_sql(base: str, source: str, specs, own=None) -> str:
    return ols_preds_sql(base, source, specs, own) + ", scores AS (" + _score_sql("preds") + ")\n"


def board_sql(scores: str, naive: str, lag: str, actual: str) -> str:
    """Leaderboard of CTE ``scores`` (in ``scores``) and the forecast by last week's value."""
    return scores + f""", last_week AS (
  SELECT u.series, '{naive}' AS model, u.year, u.{actual} AS actual, u.{lag} AS pred_level
  FROM cases u JOIN case_folds f ON u.series = f.series AND u.year = f.fold),
every AS (SELECT * FROM scores UNION ALL {_score_sql("last_week")}),
board AS (SELECT series, model, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae, count(*) AS n_folds FROM every GROUP BY 1, 2)
SELECT b.*, (v.avg_rmse - b.avg_rmse) / v.avg_rmse * 100 AS vs_naive_pct
FROM board b LEFT JOIN (SELECT series, avg_rmse FROM board WHERE model = '{naive}') v USING (series)"""


def _price_board_sql(base: str, source: str, specs, own) -> str:
    return board_sql(ols_scores_sql(base, source, specs, own), NAIVE, "price_lag1", "price")


def _used(specs, *extra) -> list[str]:
    return sorted({c for s in specs for c in (*s.features, s.target, B.actual_col(s))} | {"price_lag1", *extra})


LB_COLS = kinds("series:str model:str avg_rmse avg_mae n_folds:int vs_naive_pct")


def _ols_grid(spark, sf_dir, specs, keys=("series",)):
    u = usable_price(spark, sf_dir)
    preds = B.ols_backtest(u, specs, keys)
    return u, preds


@register("price_ols_leaderboard", LB_COLS, _price_board_sql(BASE_SQL, "usable", B.PRICE_MODELS, None))
def q_price_leaderboard(spark, sf_dir):
    """M8+F5: the OLS models of the price grid (level / Δ / log Δ, with and without
    price lags) back-tested over expanding folds, each compared with the naive forecast."""
    u, preds = _ols_grid(spark, sf_dir, B.PRICE_MODELS)
    naive = B.naive_predictions(u)
    scores = B.score(preds.select(naive.columns), ["series", "model"]).unionByName(
        B.score(naive, ["series", "model"]))
    return B.leaderboard(scores, ["series", "model"], NAIVE)


@register("price_ols_fold_scores", SCORE_COLS, ols_scores_sql(BASE_SQL, "usable", B.PRICE_MODELS) + "SELECT * FROM scores")
def q_price_fold_scores(spark, sf_dir):
    """per-year RMSE/MAE of every OLS model of the price grid."""
    _u, preds = _ols_grid(spark, sf_dir, B.PRICE_MODELS)
    return B.score(preds, ["series", "model"])


@register("extreme_weather_specs", LB_COLS, 
          _price_board_sql(BASE_SQL, "mk", B.EXTREME_SPECS, _used(B.EXTREME_SPECS + B.PRICE_MODELS, "dprice")))
def q_extreme_specs(spark, sf_dir):
    """Indicators vs degree days vs both, level and change models."""
    m = market_main(spark, sf_dir)
    u = B.complete_cases(m, B.EXTREME_SPECS + B.PRICE_MODELS, extra=["price_lag1", "dprice"])
    preds = B.ols_backtest(u, B.EXTREME_SPECS)
    naive = B.naive_predictions(u)
    scores = B.score(preds.select(naive.columns), ["series", "model"]).unionByName(
        B.score(naive, ["series", "model"]))
    return B.leaderboard(scores, ["series", "model"], NAIVE)


OLS_FULL = B.PRICE_MODELS[0]


def ols_full_table(spark, sf_dir):
    u = usable_price(spark, sf_dir)
    return E.prediction_table(B.ols_backtest(u, [OLS_FULL]), ["series", "model"])


_FULL_SQL = ols_preds_sql(BASE_SQL, "usable", [OLS_FULL]) + """, full_tbl AS (
  SELECT series, model, year, week_ending, actual, pred_level AS predicted, coverage, abs(actual - pred_level) AS abs_error,
         abs(actual - pred_level) / actual * 100 AS pct_error, actual - pred_level AS signed_error FROM preds)
"""


def _bins_sql(ctes: str, table: str, bins) -> str:
    labels, order = (" ".join(f"WHEN coverage >= {lo} AND coverage < {hi} THEN {v}" for (lo, hi, _), v in zip(bins, values, strict=True))
                     for values in ([f"'{b[2]}'" for b in bins], range(len(bins))))
    return ctes + f"""
SELECT series, model, coverage_bin, bin_order, count(*) AS n, avg(abs_error) AS mae, avg(pct_error) AS mape,
       median(abs_error) AS median_error
FROM (SELECT *, CASE {labels} END AS coverage_bin, CASE {order} END AS bin_order FROM {table})
WHERE coverage_bin IS NOT NULL GROUP BY 1, 2, 3, 4"""


@register("ols_predictions", kinds("series:str model:str year:int week_ending:date actual predicted "
                                   "coverage abs_error pct_error signed_error"), _FULL_SQL + "SELECT * FROM full_tbl")
def q_ols_predictions(spark, sf_dir):
    """out-of-sample predictions of the full OLS level model with errors."""
    return ols_full_table(spark, sf_dir)


@register("ols_error_by_coverage", COV_COLS, _bins_sql(_FULL_SQL, "full_tbl", K.COVERAGE_BINS))
def q_ols_cov(spark, sf_dir):
    """F8: full OLS error by coverage bin."""
    return E.error_by_coverage(ols_full_table(spark, sf_dir), ["series", "model"])


@register("ols_error_by_coverage3", COV_COLS, _bins_sql(_FULL_SQL, "full_tbl", K.COVERAGE_BINS_3))
def q_ols_cov3(spark, sf_dir):
    """F8 (3-bin variant)."""
    return E.error_by_coverage(ols_full_table(spark, sf_dir), ["series", "model"], K.COVERAGE_BINS_3)


_EXP_ROLL_SQL = f"""
WITH a AS ({ols_scores_sql(BASE_SQL, "usable", [OLS_FULL])} SELECT * FROM scores),
b AS ({ols_preds_sql(BASE_SQL, "usable", [OLS_FULL], rolling=True)}, trained AS (SELECT * FROM preds WHERE n_train >= {K.ROLLING_MIN_TRAIN})
{_score_sql("trained")})
SELECT a.series, a.model, a.year, a.rmse AS expanding_rmse, a.mae AS expanding_mae, b.rmse AS rolling_rmse, b.mae AS rolling_mae
FROM a LEFT JOIN b USING (series, model, year)"""


@register("expanding_vs_rolling", kinds("series:str model:str year:int expanding_rmse expanding_mae "
                                        "rolling_rmse rolling_mae"), _EXP_ROLL_SQL)
def q_exp_vs_roll(spark, sf_dir):
    """F1/F2 + J3: full OLS RMSE per year, expanding vs rolling-5 (rolling needs >= 50 rows)."""
    u = usable_price(spark, sf_dir)
    keys = ["series", "model"]
    exp_s = B.score(B.ols_backtest(u, [OLS_FULL]), keys)
    roll_s = B.score(B.ols_backtest(u, [OLS_FULL], mode="rolling",
                                    min_train_rows=K.ROLLING_MIN_TRAIN), keys)
    return E.compare_folds(exp_s, roll_s, keys)


@register("naive_error_by_coverage_figure", COV_COLS, BASE_SQL + "\n" + """
SELECT series, model, coverage_bin, bin_order, count(*) AS n, avg(abs_error) AS mae,
       avg(pct_error) AS mape, median(abs_error) AS median_error
FROM (SELECT *, """ + "CASE " + " ".join(
    f"WHEN coverage > {lo} AND coverage <= {hi} THEN '{lab}'" for lo, hi, lab in K.COVERAGE_BINS)
    + " END AS coverage_bin, CASE " + " ".join(
    f"WHEN coverage > {lo} AND coverage <= {hi} THEN {i}" for i, (lo, hi, lab) in enumerate(K.COVERAGE_BINS))
    + """ END AS bin_order FROM naive_tbl)
WHERE coverage_bin IS NOT NULL GROUP BY 1, 2, 3, 4""")
def q_naive_cov_figure(spark, sf_dir):
    """F8 (figure variant, N17): bins with (lo, hi] edges, so coverage 0 falls out."""
    t = E.prediction_table(B.naive_predictions(usable_price(spark, sf_dir)), ["series", "model"])
    return E.error_by_coverage(t, ["series", "model"], closed="right")


_SMALL_LB_SQL = BASE_SQL + """,
fit1 AS (
  SELECT f.series, f.fold, regr_slope(u.price, u.price_lag1) AS b1,
         regr_intercept(u.price, u.price_lag1) AS b0
  FROM folds f JOIN usable u ON u.series = f.series AND u.year < f.fold GROUP BY 1, 2),
mom AS (
  SELECT f.series, f.fold, avg(u.price) AS my, avg(u.price_lag1) AS m1, avg(u.volume_lag1) AS m2,
         var_pop(u.price_lag1) AS c11, var_pop(u.volume_lag1) AS c22,
         covar_pop(u.price_lag1, u.volume_lag1) AS c12,
         covar_pop(u.price_lag1, u.price) AS c1y, covar_pop(u.volume_lag1, u.price) AS c2y
  FROM folds f JOIN usable u ON u.series = f.series AND u.year < f.fold GROUP BY 1, 2),
fit2 AS (
  SELECT series, fold, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1,
         (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2, my, m1, m2 FROM mom),
preds AS (
  SELECT u.series, 'OLS price~lag1' AS model, u.year, u.price AS actual,
         fit1.b0 + fit1.b1 * u.price_lag1 AS pred_level
  FROM usable u JOIN fit1 ON u.series = fit1.series AND u.year = fit1.fold
  UNION ALL
  SELECT u.series, 'OLS price~lag1+vol' AS model, u.year, u.price AS actual,
         fit2.my - fit2.b1 * fit2.m1 - fit2.b2 * fit2.m2 + fit2.b1 * u.price_lag1
           + fit2.b2 * u.volume_lag1 AS pred_level
  FROM usable u JOIN fit2 ON u.series = fit2.series AND u.year = fit2.fold
  UNION ALL
  SELECT series, model, year, actual, pred_level FROM naive),
scores AS (""" + _score_sql("preds") + """),
board AS (SELECT series, model, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae, count(*) AS n_folds
          FROM scores GROUP BY 1, 2)
SELECT b.*, (nv.avg_rmse - b.avg_rmse) / nv.avg_rmse * 100 AS vs_naive_pct
FROM board b LEFT JOIN (SELECT series, avg_rmse FROM board WHERE model = '""" + NAIVE + """') nv
     ON b.series = nv.series"""


@register("small_model_leaderboard", LB_COLS, _SMALL_LB_SQL)
def q_small_leaderboard(spark, sf_dir):
    """M2+F3-F5: naive and one- and two-regressor OLS scored over the expanding
    folds in one pass, plain mean of yearly RMSE / MAE and the gain over naive."""
    u = usable_price(spark, sf_dir)
    cols = ["series", "model", "year", "week_ending", "coverage", "pred_level", "actual"]
    preds = B.ols_backtest(u, [OLS1, OLS2]).select(cols).unionByName(
        B.naive_predictions(u).select(cols))
    return B.leaderboard(B.score(preds, ["series", "model"]), ["series", "model"], NAIVE)


_ALL_SERIES_SQL = _price_board_sql("WITH RECURSIVE " + O.panel_cte().lstrip() + O.market_cte(series=list(CFG.commodities)) + """,
mk AS (
  SELECT *, price - price_lag1 AS dprice,
         CASE WHEN price > 0 AND price_lag1 > 0 THEN ln(price) - ln(price_lag1) END AS log_dprice FROM market)""", "mk", B.PRICE_MODELS,
                                   _used(B.PRICE_MODELS, "dprice", "log_dprice"))


@register("all_series_ols_leaderboard", LB_COLS, _ALL_SERIES_SQL)
def q_all_series_leaderboard(spark, sf_dir):
    """M8+F5 for every commodity at once: the OLS price models and the naive
    forecast back-tested per series (series is a key of every Gram, fold and
    score, so all series x models x folds run in the same jobs)."""
    from furrow.session import materialize
    m = materialize(B.add_targets(market.market_series(build_panel(spark, sf_dir), CFG,
                                                       list(CFG.commodities))))
    u = B.complete_cases(m, B.PRICE_MODELS, extra=["price_lag1", "dprice", "log_dprice"])
    preds = B.ols_backtest(u, B.PRICE_MODELS)
    naive = B.naive_predictions(u)
    scores = B.score(preds.select(naive.columns), ["series", "model"]).unionByName(
        B.score(naive, ["series", "model"]))
    return B.leaderboard(scores, ["series", "model"], NAIVE)


_J3_SQL = BASE_SQL + f""",
fit_e AS (
  SELECT f.series, f.fold, regr_slope(u.price, u.price_lag1) AS b1,
         regr_intercept(u.price, u.price_lag1) AS b0
  FROM folds f JOIN usable u ON u.series = f.series AND u.year < f.fold GROUP BY 1, 2),
fit_r AS (
  SELECT f.series, f.fold, regr_slope(u.price, u.price_lag1) AS b1,
         regr_intercept(u.price, u.price_lag1) AS b0
  FROM folds f JOIN usable u ON u.series = f.series
       AND u.year >= f.fold - {K.ROLLING_YEARS} AND u.year < f.fold
  GROUP BY 1, 2 HAVING count(*) >= 2),
pe AS (
  SELECT u.series, 'OLS price~lag1' AS model, u.year, u.price AS actual,
         fit_e.b0 + fit_e.b1 * u.price_lag1 AS pred_level
  FROM usable u JOIN fit_e ON u.series = fit_e.series AND u.year = fit_e.fold),
pr AS (
  SELECT u.series, 'OLS price~lag1' AS model, u.year, u.price AS actual,
         fit_r.b0 + fit_r.b1 * u.price_lag1 AS pred_level
  FROM usable u JOIN fit_r ON u.series = fit_r.series AND u.year = fit_r.fold),
se AS ({_score_sql("pe")}),
sr AS ({_score_sql("pr")})
SELECT se.series, se.model, se.year, se.rmse AS expanding_rmse, se.mae AS expanding_mae,
       sr.rmse AS rolling_rmse, sr.mae AS rolling_mae
FROM se LEFT JOIN sr ON se.series = sr.series AND se.model = sr.model AND se.year = sr.year"""


@register("ols1_expanding_vs_rolling", kinds("series:str model:str year:int expanding_rmse "
                                             "expanding_mae rolling_rmse rolling_mae"), _J3_SQL)
def q_ols1_exp_vs_roll(spark, sf_dir):
    """F1+F2+J3: one-regressor OLS scored per year with expanding and with
    rolling five-year training windows, the two joined on the test year."""
    u = usable_price(spark, sf_dir)
    keys = ["series", "model"]
    exp_s = B.score(B.ols_backtest(u, [OLS1]), keys)
    roll_s = B.score(B.ols_backtest(u, [OLS1], mode="rolling", min_train_rows=2), keys)
    return E.compare_folds(exp_s, roll_s, keys)


_F6_SQL = _SMALL_LB_SQL[:_SMALL_LB_SQL.index("board AS (")] + """
a AS (SELECT * FROM scores WHERE model = 'OLS price~lag1'),
b AS (SELECT * FROM scores WHERE model = 'OLS price~lag1+vol')
SELECT coalesce(a.series, b.series) AS series, coalesce(a.year, b.year) AS year, a.n AS n_test,
       a.rmse AS base_rmse, a.mae AS base_mae, b.rmse AS other_rmse, b.mae AS other_mae,
       (a.rmse - b.rmse) / a.rmse * 100 AS improvement
FROM a FULL JOIN b ON a.series = b.series AND a.year = b.year"""


@register("ols_improvement_by_year", kinds("series:str year:int n_test:int base_rmse base_mae "
                                           "other_rmse other_mae improvement"), _F6_SQL)
def q_ols_improvement(spark, sf_dir):
    """per test year, RMSE/MAE of the one- and two-regressor OLS and the %
    improvement of the second over the first."""
    u = usable_price(spark, sf_dir)
    scores = B.score(B.ols_backtest(u, [OLS1, OLS2]), ["series", "model"])
    return E.improvement(scores, ["series"], OLS1.name, OLS2.name)


_DAY = "(week_ending - DATE '1970-01-01')"
_TREND_SQL = BASE_SQL + f""",
scaled AS (
  SELECT *, ({_DAY} - avg({_DAY}) OVER (PARTITION BY series)) / 1000.0 AS u FROM market WHERE price IS NOT NULL),
powers AS (SELECT *, u * u AS u2, u * u * u AS u3, u * u * u * u AS u4 FROM scaled),
fitrows AS ({Q.rows_sql("powers", "series", "price", ["u", "u2", "u3", "u4"])}),{Q.fit_ctes("f", "fitrows")}
SELECT p.series, p.week_ending, p.price, {Q.predicted("b", "[p.u, p.u2, p.u3, p.u4]")} AS trend, n.rank
FROM powers p JOIN f_beta b ON b.g = p.series JOIN f_n n ON n.g = p.series"""


@register("price_trend", kinds("series:str week_ending:date price trend rank:int"), _TREND_SQL)
def q_price_trend(spark, sf_dir):
    """M1, rank-deficient safe: quartic trend of the price on the raw day number (nearly
    collinear powers) from merged R factors; the oracle fits centred, scaled powers."""
    from furrow.operators import linreg
    m = market_main(spark, sf_dir).where(F.col("price").isNotNull())
    day = F.datediff("week_ending", F.lit("1970-01-01").cast("date")).cast("double")
    rows = m.select("series", "week_ending", F.col("price").alias("y"), F.array(day, day**2, day**3, day**4).alias("x"))
    coefs = linreg.least_squares(rows, ["series"], method="qr")
    fitted = linreg.predict(rows, coefs, ["series"]).join(F.broadcast(coefs.select("series", "rank")), "series")
    return fitted.select("series", "week_ending", F.col("y").alias("price"), F.col("pred").alias("trend"), "rank")
