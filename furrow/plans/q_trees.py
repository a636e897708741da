"""Tree-model queries (M9-M11, F6, M14, M15). Rows-only: no SQL oracle can
express a tree learner; tests check their invariants instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import DRIVER as CFG
from furrow.operators import backtest as B
from furrow.operators import evaluate as E
from furrow.operators import impute as I
from furrow.operators import trees as TR
from furrow.plans import ols_sql as Q
from furrow.plans import oracle as O
from furrow.plans.q_models import BASE_SQL, NAIVE, usable_price
from furrow.plans.q_panel import build_panel
from furrow.plans.registry import register
from furrow.plans.spec import kinds
from furrow.session import materialize

SCORE_COLS = kinds("series:str model:str year:int n:int rmse mae")

BOOST_FULL = B.PRICE_MODELS[2]   # Boosted Level (full): 200 trees, depth 3
FOREST_FULL = B.PRICE_MODELS[4]  # RF Level (full): 500 trees, depth 6
BOOST_DEEP = B.ModelSpec("Boosted Level (deep)", tuple(K.LEVEL_FEATURES), "price", "boost",
                         params=tuple(sorted(K.BOOST_DEEP.items())))


@register("boost_backtest_scores", SCORE_COLS)
def q_boost_backtest(spark, sf_dir):
    """M9+F1+F4: gradient-boosted trees (200 x depth 3) over expanding folds."""
    u = usable_price(spark, sf_dir)
    return B.score(TR.tree_backtest(spark, u, [BOOST_FULL]), ["series", "model"])


@register("forest_backtest_scores", SCORE_COLS)
def q_forest_backtest(spark, sf_dir):
    """M10+F1+F4: random forest (500 x depth 6, leaf 10, 70 % features) over expanding folds."""
    u = usable_price(spark, sf_dir)
    return B.score(TR.tree_backtest(spark, u, [FOREST_FULL]), ["series", "model"])


@register("ols_vs_boost", kinds("series:str test_year:int n_train:int n_test:int ols_rmse ols_mae "
                                "boost_rmse boost_mae improvement"))
def q_ols_vs_boost(spark, sf_dir):
    """F6+J3: OLS vs boosted trees (300 x depth 5) per fold and the % improvement
    (the fold-score table of the comparison)."""
    u = usable_price(spark, sf_dir)
    ols = B.ols_backtest(u, [B.PRICE_MODELS[0]])
    cols = ["series", "model", "year", "week_ending", "coverage", "pred_level", "actual"]
    trees = TR.tree_backtest(spark, u, [BOOST_DEEP])
    scores = B.score(ols.select(cols).unionByName(trees.select(cols)), ["series", "model"])
    imp = E.improvement(scores, ["series"], B.PRICE_MODELS[0].name, BOOST_DEEP.name)
    n_train = ols.groupBy("series", "year").agg(F.max("n_train").alias("n_train"))
    return imp.join(n_train, ["series", "year"], "left").select(
        "series", F.col("year").alias("test_year"), "n_train", "n_test",
        F.col("base_rmse").alias("ols_rmse"), F.col("base_mae").alias("ols_mae"),
        F.col("other_rmse").alias("boost_rmse"), F.col("other_mae").alias("boost_mae"), "improvement")


@register("price_model_leaderboard", kinds("series:str model:str avg_rmse avg_mae n_folds:int "
                                           "vs_naive_pct"))
def q_full_leaderboard(spark, sf_dir):
    """M8+F5: all eleven price models (OLS, boosted, forest; level, Δ, log Δ) and naive."""
    u = usable_price(spark, sf_dir)
    cols = ["series", "model", "year", "week_ending", "coverage", "pred_level", "actual"]
    ols = B.ols_backtest(u, B.PRICE_MODELS).select(cols)
    trees = TR.tree_backtest(spark, u, B.PRICE_MODELS).select(cols)
    naive = B.naive_predictions(u).select(cols)
    scores = B.score(ols.unionByName(trees).unionByName(naive), ["series", "model"])
    return B.leaderboard(scores, ["series", "model"], NAIVE)


@register("feature_importance", kinds("series:str feature:str level_importance change_importance "
                                      "total rank:int"))
def q_feature_importance(spark, sf_dir):
    """M11+O2: boosted-tree importances of the level and Δprice models side by side,
    the 15 largest by their sum (full outer join on the feature)."""
    u = usable_price(spark, sf_dir)
    kv = {"series": CFG.main_series}
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=2) as pool:  # two independent Spark ML fits
        lv, ch = pool.map(lambda spec: TR.importances(spark, u, spec, kv),
                          [B.PRICE_MODELS[2], B.PRICE_MODELS[7]])
    lv = lv.select("series", "feature", F.col("importance").alias("level_importance"))
    ch = ch.select("series", "feature", F.col("importance").alias("change_importance"))
    j = lv.join(ch, ["series", "feature"], "full").na.fill(0.0, ["level_importance",
                                                                  "change_importance"])
    j = j.withColumn("total", F.col("level_importance") + F.col("change_importance"))
    from pyspark.sql import Window
    w = Window.partitionBy("series").orderBy(F.col("total").desc(), F.col("feature"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 15)


_OLS_IMPORTANCE_SQL = f"""{BASE_SQL},
fitrows AS ({Q.rows_sql("usable", "series", "price", K.LEVEL_FEATURES)}),{Q.fit_ctes("f", "fitrows")}
SELECT g AS series, '{B.PRICE_MODELS[0].name}' AS model, terms.term AS feature, abs(s.slope) AS importance,
       row_number() OVER (PARTITION BY g ORDER BY abs(s.slope) DESC, terms.term) AS rank
FROM f_slope s JOIN {Q.terms_sql([("all", K.LEVEL_FEATURES)])} ON terms.idx = s.i"""


@register("ols_importance", kinds("series:str model:str feature:str importance rank:int"), _OLS_IMPORTANCE_SQL)
def q_ols_importance(spark, sf_dir):
    """Absolute OLS coefficients as importance (full model on all usable rows)."""
    from furrow.operators import linreg
    u = usable_price(spark, sf_dir)
    spec = B.PRICE_MODELS[0]
    design = B.design_rows(u, [spec], ["series"])
    coefs = linreg.least_squares(design, ["series", "model"])
    names = F.array(*[F.lit(t) for t in spec.features])
    exploded = coefs.select("series", "model",
                            F.posexplode(F.slice("beta", 2, len(spec.features))).alias("i", "b"))
    out = exploded.select("series", "model", names[F.col("i")].alias("feature"),
                          F.abs("b").alias("importance"))
    from pyspark.sql import Window
    w = Window.partitionBy("series", "model").orderBy(F.col("importance").desc(), "feature")
    return out.withColumn("rank", F.row_number().over(w))


# ------------------------------------------------------ missing prices

def _impute_frame(spark, sf_dir):
    # The panel is read twice, for its districts and for its rows; the feeds only once.
    return materialize(I.imputation_frame(materialize(build_panel(spark, sf_dir)), CFG))


@register("impute_backtest", kinds("series:str year:int n:int ols_rmse ols_mae boost_rmse boost_mae"))
def q_impute_backtest(spark, sf_dir):
    """Yearly OLS and boosted-tree RMSE/MAE on district-weeks with a price."""
    return I.imputation_backtest(spark, _impute_frame(spark, sf_dir), CFG)


@register("impute_predictions", kinds("series:str week_ending:date district:str volume "
                                      "predicted_price"))
def q_impute_predictions(spark, sf_dir):
    """M14+P29: boosted-tree price for district-weeks with volume but no price (clipped at 0)."""
    return I.impute_missing(spark, _impute_frame(spark, sf_dir), CFG)


@register("impute_by_district", kinds("series:str district:str n_predicted:int predicted_mean "
                                      "observed_mean"))
def q_impute_by_district(spark, sf_dir):
    """M14+J: predicted vs observed mean price per district."""
    f = _impute_frame(spark, sf_dir)
    return I.compare_by_district(I.impute_missing(spark, f, CFG), f)


@register("boost_importance", kinds("series:str model:str feature:str importance rank:int"))
def q_boost_importance(spark, sf_dir):
    """M9+M11: one boosted-tree fit (200 x depth 3) of the full level model on all
    usable rows, its feature importances ranked."""
    u = usable_price(spark, sf_dir)
    imp = TR.importances(spark, u, BOOST_FULL, {"series": CFG.main_series})
    from pyspark.sql import Window
    w = Window.partitionBy("series", "model").orderBy(F.col("importance").desc(), "feature")
    return imp.withColumn("rank", F.row_number().over(w))


@register("forest_importance", kinds("series:str model:str feature:str importance rank:int"))
def q_forest_importance(spark, sf_dir):
    """M10+M11: one random-forest fit (500 x depth 6, leaf 10, 70 % features)
    of the full level model on all usable rows, its feature importances ranked."""
    u = usable_price(spark, sf_dir)
    imp = TR.importances(spark, u, FOREST_FULL, {"series": CFG.main_series})
    from pyspark.sql import Window
    w = Window.partitionBy("series", "model").orderBy(F.col("importance").desc(), "feature")
    return imp.withColumn("rank", F.row_number().over(w))


_IMPUTE_OLS_SQL = "WITH " + O.panel_cte().lstrip() + f""",
f AS (SELECT district, week_ending, coalesce(vol_{CFG.suffix(CFG.main_series)}, 0.0) AS volume,
             CASE WHEN price_{CFG.suffix(CFG.main_series)} <> 0
                  THEN price_{CFG.suffix(CFG.main_series)} END AS price FROM panel),
obs AS (SELECT * FROM f WHERE price IS NOT NULL AND volume > 0),
mis AS (SELECT * FROM f WHERE price IS NULL AND volume > 0),
fit AS (SELECT regr_slope(price, volume) AS b1, regr_intercept(price, volume) AS b0 FROM obs),
pred AS (SELECT m.district, greatest(fit.b0 + fit.b1 * m.volume, 0.0) AS p FROM mis m, fit)
SELECT '{CFG.main_series}' AS series, p.district, count(*) AS n_predicted, avg(p.p) AS predicted_mean,
       o.observed_mean
FROM pred p LEFT JOIN (SELECT district, avg(price) AS observed_mean FROM obs GROUP BY 1) o
     ON p.district = o.district
GROUP BY p.district, o.observed_mean"""


@register("impute_ols_by_district", kinds("series:str district:str n_predicted:int predicted_mean "
                                          "observed_mean"), _IMPUTE_OLS_SQL)
def q_impute_ols_by_district(spark, sf_dir):
    """M14+P29: missing district prices from a least-squares fit of price on
    volume over the observed district-weeks (volume > 0), clipped at 0, and
    predicted vs observed mean per district."""
    f = _impute_frame(spark, sf_dir)
    pred = I.impute_missing_ols(f, ["volume"])
    return I.compare_by_district(pred, f, ["volume"])


_IMPUTE_BT_SQL = _IMPUTE_OLS_SQL[:_IMPUTE_OLS_SQL.index("mis AS (")] + f"""
yrs AS (SELECT year, dense_rank() OVER (ORDER BY year) AS r
        FROM (SELECT DISTINCT year(week_ending) AS year FROM obs)),
folds AS (SELECT year AS fold FROM yrs WHERE r > {K.MIN_TRAIN_YEARS}),
fit AS (SELECT f.fold, regr_slope(o.price, o.volume) AS b1, regr_intercept(o.price, o.volume) AS b0
        FROM folds f JOIN obs o ON year(o.week_ending) < f.fold GROUP BY 1),
pred AS (SELECT year(o.week_ending) AS year, o.price AS actual, fit.b0 + fit.b1 * o.volume AS p
         FROM obs o JOIN fit ON year(o.week_ending) = fit.fold)
SELECT '{CFG.main_series}' AS series, year, count(*) AS n,
       sqrt(avg((actual - p) * (actual - p))) AS ols_rmse, avg(abs(actual - p)) AS ols_mae
FROM pred GROUP BY 1, 2"""


@register("impute_ols_backtest", kinds("series:str year:int n:int ols_rmse ols_mae"), _IMPUTE_BT_SQL)
def q_impute_ols_backtest(spark, sf_dir):
    """Least-squares price on volume over observed district-weeks,
    back-tested on expanding years (every year after the first four)."""
    f = _impute_frame(spark, sf_dir)
    observed, _ = I.split(f, ["volume"])
    spec = B.ModelSpec("OLS impute (volume)", ("volume",), "price")
    obs = observed.withColumn("coverage", F.lit(None).cast("double"))
    s = B.score(B.ols_backtest(obs, [spec], extra=("week_ending", "price", "coverage")),
                ["series", "model"])
    return s.select("series", "year", "n", F.col("rmse").alias("ols_rmse"), F.col("mae").alias("ols_mae"))


_RF_FULL = next(s for s in B.PRICE_MODELS if s.method == "forest")
_TREE_FOLDS_SQL = BASE_SQL + f"""
SELECT u.series, '{_RF_FULL.name}' AS model, u.year, count(*) AS n, 1 AS in_range
FROM usable u JOIN folds f ON u.series = f.series AND u.year = f.fold GROUP BY 1, 2, 3"""


@register("forest_folds", kinds("series:str model:str year:int n:int in_range:int"), _TREE_FOLDS_SQL)
def q_forest_folds(spark, sf_dir):
    """M10+F1: forests back-tested over the expanding folds; every test row of a fold gets a
    prediction, and a mean of leaf means lies within the prices of the earlier years."""
    from pyspark.sql import Window
    u = usable_price(spark, sf_dir)
    preds = TR.tree_backtest(spark, u, [_RF_FULL], scale=0.02)
    years = u.groupBy("series", "year").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    before = Window.partitionBy("series").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    span = years.select("series", "year", F.min("low").over(before).alias("low"), F.max("high").over(before).alias("high"))
    inside = F.col("pred_level").between(F.col("low") - 1e-6, F.col("high") + 1e-6)
    return preds.join(span, ["series", "year"]).groupBy("series", "model", "year").agg(
        F.count("pred_level").alias("n"), F.min(inside.cast("int")).alias("in_range"))
