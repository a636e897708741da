"""In-sample OLS inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import DRIVER as CFG
from furrow.operators import backtest as B
from furrow.operators import market
from furrow.operators import profile as PR
from furrow.operators import specs as S
from furrow.plans import ols_sql as Q
from furrow.plans import oracle as O
from furrow.plans.q_models import BASE_SQL, market_main, ols_scores_sql
from furrow.plans.q_panel import build_panel
from furrow.plans.registry import register
from furrow.plans.spec import kinds
from furrow.session import materialize

COEF_COLS = kinds("series:str spec:str idx:int term:str coef se z p stars:str")
FIT_COLS = kinds("series:str spec:str nobs:int k:int r2 adj_r2 rmse n_clusters:int few_clusters:int")
SER = [(CFG.main_series,)]


def _spec_ctes(base: str, source: str, specs, cluster: str | None = None) -> str:
    """``base`` and the fits of all ``specs`` on ``source``, groups series|spec."""
    rows = " UNION ALL ".join(
        Q.rows_sql(source, f"series || '|{s.name}'", s.target, s.features, s.where or "TRUE", cluster=cluster or "NULL") for s in specs)
    return f"{base},\nfitrows AS ({rows}),{Q.inference_ctes('f', 'fitrows', cluster is not None)}"


def _coef_sql(base: str, source: str, specs, cluster: str | None = None) -> str:
    return f"""{_spec_ctes(base, source, specs, cluster)},
coefs AS (
  SELECT split_part(c.g, '|', 1) AS series, terms.spec, c.idx, terms.term, c.coef, c.se, c.z, c.p, {Q.stars_sql("c.p", K.STARS)} AS stars
  FROM f_coef c JOIN {Q.terms_sql([(s.name, s.features) for s in specs])} ON split_part(c.g, '|', 2) = terms.spec AND c.idx = terms.idx)
SELECT * FROM coefs"""


def _fit_sql(base: str, source: str, specs, cluster: str | None = None) -> str:
    return (_spec_ctes(base, source, specs, cluster)
            + "\nSELECT split_part(g, '|', 1) AS series, split_part(g, '|', 2) AS spec, * EXCLUDE (g) FROM f_fit")


def _side_by_side_sql(coef_sql: str, specs, terms) -> str:
    columns = ", ".join(f"""max(CASE WHEN spec = '{s.name}' THEN coef END) AS "{s.name}_coef",
       max(CASE WHEN spec = '{s.name}' THEN stars END) AS "{s.name}_stars\"""" for s in specs)
    names = ", ".join(f"'{t}'" for t in terms)
    return coef_sql.removesuffix("SELECT * FROM coefs") + (
        f"SELECT series, term, {columns} FROM coefs WHERE term IN ({names}) GROUP BY 1, 2")


_LOG_SQL = BASE_SQL + """,
logged AS (SELECT *, CASE WHEN price > 0 THEN ln(price) END AS log_price FROM mk)"""
_DISTRICT_SQL = "WITH RECURSIVE " + O.panel_cte().lstrip() + O.district_cte() + f""",
dummies AS (
  SELECT *, price - price_lag1 AS dprice, volume - volume_lag1 AS volume_change,
         CASE WHEN district = '{CFG.core_districts[1]}' THEN 1 ELSE 0 END AS d_az,
         CASE WHEN district = '{CFG.core_districts[2]}' THEN 1 ELSE 0 END AS d_third,
         {", ".join(f"CASE WHEN month IN ({', '.join(map(str, m))}) THEN 1 ELSE 0 END AS {q}" for q, m in K.QUARTER_MONTHS.items())},
         CASE WHEN {" OR ".join(f"week_of_year BETWEEN {a} AND {b}" for a, b in K.TRANSITION_WEEKS)} THEN 1 ELSE 0 END AS transition_week
  FROM dist),
panel_rows AS (
  SELECT *, d_az * q1 AS az_winter, d_az * q2 AS az_spring, dd_freeze * transition_week AS freeze_x_transition,
         dd_heat * transition_week AS heat_x_transition, ppt_total * transition_week AS ppt_x_transition
  FROM dummies)"""
_VARIETY_SQL = "WITH RECURSIVE " + O.panel_cte().lstrip() + O.market_cte(series=[CFG.main_series]) + O.market_cte(
    series=[CFG.second_series], round_all=False, name="second") + """,
both_series AS (
  SELECT *, price - price_lag1 AS dprice FROM (SELECT * FROM market UNION ALL SELECT * FROM second))"""


def _baseline(spark, sf_dir):
    m = S.with_log_price(market_main(spark, sf_dir))
    return S.fit_specs(spark, m, S.baseline_specs(), ["series"], SER, cov="HC1")


@register("insample_ols_coefficients", COEF_COLS, _coef_sql(_LOG_SQL, "logged", S.baseline_specs()))
def q_baseline_coefs(spark, sf_dir):
    """M3+M5+M13: baseline specs 1-3 with HC1 errors, normal p-values and stars."""
    return _baseline(spark, sf_dir)[0]


@register("insample_ols_fit", FIT_COLS, _fit_sql(_LOG_SQL, "logged", S.baseline_specs()))
def q_baseline_fit(spark, sf_dir):
    """M3+M5: N, R², adjusted R², RMSE = sqrt(SSR / (N - k)) per baseline spec."""
    return _baseline(spark, sf_dir)[1]


def district_frame(spark, sf_dir):
    """District modelling set; checkpointed because every spec reads it."""
    d = S.district_design(market.district_series(build_panel(spark, sf_dir), CFG), CFG)
    return materialize(d)


def _district(spark, sf_dir):
    return S.fit_specs(spark, district_frame(spark, sf_dir), S.district_specs(), ["series"], SER,
                       cov="cluster", cluster="district")


@register("district_panel_coefficients", COEF_COLS, _coef_sql(_DISTRICT_SQL, "panel_rows", S.district_specs(), "district"))
def q_district_coefs(spark, sf_dir):
    """M4+M6+P21-P24: district panel specs 1-5, errors clustered by district."""
    return _district(spark, sf_dir)[0]


@register("district_panel_fit", FIT_COLS, _fit_sql(_DISTRICT_SQL, "panel_rows", S.district_specs(), "district"))
def q_district_fit(spark, sf_dir):
    """M4+M6: fit statistics and cluster count of the district specs."""
    return _district(spark, sf_dir)[1]


_TRANSITION_SQL = "WITH " + O.panel_cte().lstrip() + O.district_cte() + """
SELECT series, transition_week, count(*) AS n,
       count(*) / sum(count(*)) OVER (PARTITION BY series) AS share,
       avg(dprice) AS mean_dprice, stddev_samp(dprice) AS sd_dprice, avg(has_price) AS mean_coverage
FROM (SELECT *, price - price_lag1 AS dprice,
             CASE WHEN """ + " OR ".join(f"week_of_year BETWEEN {a} AND {b}"
                                        for a, b in K.TRANSITION_WEEKS) + """ THEN 1 ELSE 0 END
               AS transition_week FROM dist)
GROUP BY 1, 2"""


@register("transition_split", kinds("series:str transition_week:int n:int share mean_dprice "
                                    "sd_dprice mean_coverage"), _TRANSITION_SQL)
def q_transition_split(spark, sf_dir):
    """Δprice mean / sd and share of rows inside vs outside transition weeks."""
    return PR.transition_split(district_frame(spark, sf_dir), ["series"])


def _volume(spark, sf_dir):
    return S.fit_specs(spark, market_main(spark, sf_dir), S.volume_specs(), ["series"], SER)


@register("volume_ols_coefficients", COEF_COLS, _coef_sql(BASE_SQL, "mk", S.volume_specs()))
def q_volume_coefs(spark, sf_dir):
    """M7: volume level / change OLS in sample with HC1 errors."""
    return _volume(spark, sf_dir)[0]


@register("volume_ols_fit", FIT_COLS, _fit_sql(BASE_SQL, "mk", S.volume_specs()))
def q_volume_fit(spark, sf_dir):
    """M7: volume model fit statistics."""
    return _volume(spark, sf_dir)[1]


@register("volume_backtest", kinds("series:str model:str avg_rmse avg_mae n_folds:int vs_naive_pct"))
def q_volume_backtest(spark, sf_dir):
    """M7+F3-F5: naive, OLS and boosted volume forecasts (level and change) over
    expanding folds."""
    from furrow.operators import trees as TR
    m = market_main(spark, sf_dir)
    u = B.complete_cases(m, B.VOLUME_MODELS, extra=["dvolume", "volume_lag1"])
    naive = B.naive_predictions(u, target="volume", name="Naive (vol=lag1)")
    cols = ["series", "model", "year", "week_ending", "coverage", "pred_level", "actual"]
    scores = B.score(naive, ["series", "model"])
    for preds in (B.ols_backtest(u, B.VOLUME_MODELS), TR.tree_backtest(spark, u, B.VOLUME_MODELS)):
        scores = scores.unionByName(B.score(preds.select(cols), ["series", "model"]))
    return B.leaderboard(scores, ["series", "model"], "Naive (vol=lag1)")


_PERIOD_ROWS = BASE_SQL + """,
by_period AS (SELECT *, CASE """ + " ".join(f"WHEN year BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in CFG.periods) + """ END AS period
              FROM usable)"""
_PERIOD_COEF_SQL = f"""{_PERIOD_ROWS},
fitrows AS ({Q.rows_sql("by_period", "series || '|' || period", "price", K.LEVEL_FEATURES, "period IS NOT NULL")}),{Q.fit_ctes("f", "fitrows")},
every AS (SELECT g, 0 AS idx, b0 AS coef FROM f_beta UNION ALL SELECT g, i, slope FROM f_slope)
SELECT split_part(g, '|', 1) AS series, split_part(g, '|', 2) AS period, every.idx, terms.term, coef
FROM every JOIN f_n USING (g) JOIN {Q.terms_sql([("all", K.LEVEL_FEATURES)])} ON terms.idx = every.idx WHERE n >= {K.PERIOD_MIN_ROWS}"""


@register("period_coefficients", kinds("series:str period:str idx:int term:str coef"), _PERIOD_COEF_SQL)
def q_period_coefficients(spark, sf_dir):
    """Full OLS refitted on three periods (periods under 30 rows skipped)."""
    from furrow.plans.q_models import usable_price
    return B.period_coefficients(usable_price(spark, sf_dir), K.LEVEL_FEATURES, "price", CFG.periods)


def _variety(spark, sf_dir):
    p = build_panel(spark, sf_dir)
    main = market.market_series(p, CFG, [CFG.main_series])
    second = market.market_series(p, CFG, [CFG.second_series], round_all=False)
    both = materialize(B.add_targets(main.unionByName(second)))
    keys = [(CFG.main_series,), (CFG.second_series,)]
    return both, S.fit_specs(spark, both, S.variety_specs(), ["series"], keys)


@register("variety_fit", FIT_COLS, _fit_sql(_VARIETY_SQL, "both_series", S.variety_specs()))
def q_variety_fit(spark, sf_dir):
    """In-sample level / change fit of the main and the second series."""
    return _variety(spark, sf_dir)[1][1]


_SIGN_TERMS = K.WEATHER_NOW + ["price_lag1"]
_VARIETY_SIGNS_SQL = _coef_sql(_VARIETY_SQL, "both_series", S.variety_specs()).removesuffix("SELECT * FROM coefs") + f"""
SELECT a.spec, a.term, a.coef AS a_coef, a.p AS a_p, a.stars AS a_stars, b.coef AS b_coef, b.p AS b_p, b.stars AS b_stars,
       CASE WHEN a.coef * b.coef > 0 THEN 1 ELSE 0 END AS same_sign
FROM (SELECT * FROM coefs WHERE series = '{CFG.main_series}') a JOIN (SELECT * FROM coefs WHERE series = '{CFG.second_series}') b
     ON a.spec = b.spec AND a.term = b.term WHERE a.term IN ({", ".join(f"'{t}'" for t in _SIGN_TERMS)})"""


@register("variety_coefficient_signs", kinds("spec:str term:str a_coef a_p a_stars:str b_coef b_p "
                                              "b_stars:str same_sign:int"), _VARIETY_SIGNS_SQL)
def q_variety_signs(spark, sf_dir):
    """M16+J4: weather coefficients of both series side by side with a same-sign test."""
    coefs = _variety(spark, sf_dir)[1][0]
    a = coefs.where(F.col("series") == CFG.main_series)
    b = coefs.where(F.col("series") == CFG.second_series)
    return S.compare_coefficients(a, b, ["spec"], ("a", "b"), _SIGN_TERMS)


_VARIETY_MODEL = B.ModelSpec("OLS Level (variety)", tuple(S.variety_specs()[0].features), "price")
_VARIETY_SCORES_SQL = ols_scores_sql(_VARIETY_SQL, "both_series", [_VARIETY_MODEL], own=[*_VARIETY_MODEL.features, "price"])


@register("variety_backtest", kinds("series:str model:str year:int n:int rmse mae"), _VARIETY_SCORES_SQL + "SELECT * FROM scores")
def q_variety_backtest(spark, sf_dir):
    """M16+F1: expanding OLS level back-test for both series (series is a key)."""
    both = _variety(spark, sf_dir)[0]
    u = both.na.drop(subset=list(_VARIETY_MODEL.features) + ["price"])
    return B.score(B.ols_backtest(u, [_VARIETY_MODEL]), ["series", "model"])


# ------------------------------------------------- oracle-checked inference

_HC1_SQL = BASE_SQL + """,
d AS (SELECT series, price AS y, price_lag1 AS x FROM market
      WHERE price IS NOT NULL AND price_lag1 IS NOT NULL),
m AS (SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my,
             regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_sxx(y, x) AS sxx,
             regr_syy(y, x) AS syy FROM d GROUP BY 1),
e AS (SELECT d.series, d.x - m.mx AS xc, d.y - m.b0 - m.b1 * d.x AS e FROM d JOIN m USING (series))
SELECT m.series, m.n AS nobs, m.b0 AS intercept, m.b1 AS slope,
       sqrt(m.n / (m.n - 2.0) * s.sw / (m.sxx * m.sxx)) AS se_slope,
       1 - s.ssr / m.syy AS r2
FROM m JOIN (SELECT series, sum(xc * xc * e * e) AS sw, sum(e * e) AS ssr FROM e GROUP BY 1) s
     USING (series)"""

ONE_COLS = kinds("series:str nobs:int intercept slope se_slope r2")


def _one_regressor(spark, df, target, feature, cov, cluster=None):
    spec = S.Spec("one", target, (feature,))
    coefs, fit = S.fit_specs(spark, df, [spec], ["series"], SER, cov=cov, cluster=cluster)
    c0 = coefs.where(F.col("idx") == 0).select("series", F.col("coef").alias("intercept"))
    c1 = coefs.where(F.col("idx") == 1).select("series", F.col("coef").alias("slope"),
                                               F.col("se").alias("se_slope"))
    return fit.select("series", "nobs", "r2").join(c0, "series").join(c1, "series")


@register("hc1_one_regressor", ONE_COLS, _HC1_SQL)
def q_hc1_one(spark, sf_dir):
    """M3: price ~ price_lag1 in sample, HC1 standard error of the slope, R²."""
    return _one_regressor(spark, market_main(spark, sf_dir), "price", "price_lag1", "HC1")


_CL_SQL = "WITH " + O.panel_cte().lstrip() + O.district_cte() + """,
d AS (SELECT series, district, price - price_lag1 AS y, tmax_avg AS x FROM dist
      WHERE price IS NOT NULL AND price_lag1 IS NOT NULL AND tmax_avg IS NOT NULL),
m AS (SELECT series, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b1,
             regr_intercept(y, x) AS b0, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
             count(DISTINCT district) AS g FROM d GROUP BY 1),
u AS (SELECT d.series, d.district, sum((d.x - m.mx) * (d.y - m.b0 - m.b1 * d.x)) AS s,
             sum((d.y - m.b0 - m.b1 * d.x) * (d.y - m.b0 - m.b1 * d.x)) AS ssr
      FROM d JOIN m USING (series) GROUP BY 1, 2)
SELECT m.series, m.n AS nobs, m.b0 AS intercept, m.b1 AS slope,
       sqrt(m.g / (m.g - 1.0) * (m.n - 1.0) / (m.n - 2.0) * sum(u.s * u.s) / (m.sxx * m.sxx)) AS se_slope,
       1 - sum(u.ssr) / m.syy AS r2
FROM m JOIN u USING (series) GROUP BY m.series, m.n, m.b0, m.b1, m.g, m.sxx, m.syy"""


@register("cluster_one_regressor", ONE_COLS, _CL_SQL)
def q_cluster_one(spark, sf_dir):
    """M4: Δprice ~ tmax_avg on the district set, errors clustered by district."""
    d = district_frame(spark, sf_dir)
    return _one_regressor(spark, d, "dprice", "tmax_avg", "cluster", "district")


def _pivot_specs(coefs, specs, terms):
    """One row per term, coefficient and stars of each spec side by side
    (explicit pivot values: the spec registry)."""
    c = coefs.where(F.col("term").isin(list(terms)))
    names = [s.name for s in specs]
    return (c.groupBy("series", "term").pivot("spec", names)
             .agg(F.first("coef").alias("coef"), F.first("stars").alias("stars")))


def _pivot_cols(specs):
    out = kinds("series:str term:str")
    for s in specs:
        out += [(f"{s.name}_coef", "dbl"), (f"{s.name}_stars", "str")]
    return out


_DIST4 = S.district_specs()[:4]


@register("district_weather_coefficients", _pivot_cols(_DIST4), 
          _side_by_side_sql(_coef_sql(_DISTRICT_SQL, "panel_rows", _DIST4, "district"), _DIST4, K.WEATHER_NOW))
def q_district_weather_coefs(spark, sf_dir):
    """J4+M13: weather coefficients of district models 1-4 side by side with stars."""
    return _pivot_specs(_district(spark, sf_dir)[0], _DIST4, K.WEATHER_NOW)


@register("volume_weather_coefficients", _pivot_cols(S.volume_specs()), 
          _side_by_side_sql(_coef_sql(BASE_SQL, "mk", S.volume_specs()), S.volume_specs(), K.WEATHER_NOW))
def q_volume_weather_coefs(spark, sf_dir):
    """J4+M13: weather coefficients of the volume level and change models side by side."""
    return _pivot_specs(_volume(spark, sf_dir)[0], S.volume_specs(), K.WEATHER_NOW)


@register("variety_rmse_by_year", kinds("year:int main_rmse second_rmse"), _VARIETY_SCORES_SQL + f"""
SELECT year, max(CASE WHEN series = '{CFG.main_series}' THEN rmse END) AS main_rmse,
       max(CASE WHEN series = '{CFG.second_series}' THEN rmse END) AS second_rmse FROM scores GROUP BY 1""")
def q_variety_by_year(spark, sf_dir):
    """J3+M16: expanding OLS level RMSE per test year, main vs second series."""
    s = q_variety_backtest(spark, sf_dir)
    a = s.where(F.col("series") == CFG.main_series).select("year", F.col("rmse").alias("main_rmse"))
    b = s.where(F.col("series") == CFG.second_series).select("year", F.col("rmse").alias("second_rmse"))
    return a.join(b, "year", "full")


_PERIOD_SQL = BASE_SQL + """,
p AS (SELECT *, CASE """ + " ".join(f"WHEN year BETWEEN {lo} AND {hi} THEN '{n}'"
                                    for n, lo, hi in CFG.periods) + """ END AS period FROM usable)
SELECT series, period, count(*) AS n, regr_intercept(price, price_lag1) AS intercept,
       regr_slope(price, price_lag1) AS slope
FROM p WHERE period IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= """ + str(K.PERIOD_MIN_ROWS)


@register("period_slopes", kinds("series:str period:str n:int intercept slope"), _PERIOD_SQL)
def q_period_slopes(spark, sf_dir):
    """Price ~ price_lag1 refitted on each period from the period's Gram
    (periods with fewer than 30 rows skipped)."""
    from furrow.plans.q_models import usable_price
    c = B.period_coefficients(usable_price(spark, sf_dir), ["price_lag1"], "price", CFG.periods)
    return c.groupBy("series", "period", "n").agg(F.max(F.when(F.col("idx") == 0, F.col("coef"))).alias("intercept"),
                                                  F.max(F.when(F.col("idx") == 1, F.col("coef"))).alias("slope"))


_SIGNS_SQL = "WITH " + O.panel_cte().lstrip() + O.market_cte(
    series=[CFG.main_series]) + O.market_cte(series=[CFG.second_series], round_all=False,
                                             name="second") + """,
two_series AS (SELECT * FROM market UNION ALL SELECT * FROM second),
fits AS (
  SELECT series, 'price_lag1' AS term, regr_slope(price, price_lag1) AS coef FROM two_series
  WHERE price IS NOT NULL AND price_lag1 IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT series, 'tmax_avg' AS term, regr_slope(price - price_lag1, tmax_avg) AS coef FROM two_series
  WHERE price IS NOT NULL AND price_lag1 IS NOT NULL AND tmax_avg IS NOT NULL GROUP BY 1)
SELECT a.term, a.coef AS a_coef, b.coef AS b_coef,
       CASE WHEN a.coef * b.coef > 0 THEN 1 ELSE 0 END AS same_sign
FROM (SELECT * FROM fits WHERE series = '""" + CFG.main_series + """') a
FULL JOIN (SELECT * FROM fits WHERE series = '""" + CFG.second_series + """') b ON a.term = b.term"""


@register("variety_slope_signs", kinds("term:str a_coef b_coef same_sign:int"), _SIGNS_SQL)
def q_variety_slope_signs(spark, sf_dir):
    """M16+J4: one-regressor fits (price ~ price_lag1, Δprice ~ tmax_avg) of the
    main and second series side by side on the term, with a same-sign test."""
    both = _variety(spark, sf_dir)[0]
    specs = [S.Spec("lag", "price", ("price_lag1",)), S.Spec("heat", "dprice", ("tmax_avg",))]
    design = S.stacked_design(both, specs, ["series"])
    from furrow.operators import linreg
    c = linreg.least_squares(design, ["series", "spec"])
    t = c.select("series", F.when(F.col("spec") == "lag", "price_lag1").otherwise("tmax_avg")
                 .alias("term"), F.col("beta")[1].alias("coef"),
                 F.lit("").alias("stars"), F.lit(None).cast("double").alias("p"))
    a = t.where(F.col("series") == CFG.main_series).drop("series")
    b = t.where(F.col("series") == CFG.second_series).drop("series")
    return S.compare_coefficients(a, b, [], ("a", "b"))
