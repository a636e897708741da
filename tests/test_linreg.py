"""OLS engine vs dense NumPy references (fit, folds, HC1, clustered)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import backtest as B
from furrow.operators import linreg
from furrow.operators import specs as S


def _data(spark, n=120, seed=3, collinear=False):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(10, 3, n)
    x2 = rng.normal(-2, 1, n)
    x3 = x1 - x2 if collinear else rng.normal(0, 2, n)
    y = 1.5 + 0.8 * x1 - 1.2 * x2 + 0.3 * x3 + rng.normal(0, 0.5, n)
    year = np.repeat(np.arange(2000, 2000 + n // 20), 20)[:n]
    g = rng.integers(0, 6, n)
    rows = [("S", int(yr), int(gg), float(a), float(b), float(c), float(t))
            for yr, gg, a, b, c, t in zip(year, g, x1, x2, x3, y)]
    df = spark.createDataFrame(rows, "series string, year int, g int, x1 double, x2 double, x3 double, y double")
    return df, np.column_stack([x1, x2, x3]), y, year, g


def test_gram_solve_matches_lstsq(spark):
    df, X, y, _, _ = _data(spark)
    d = df.select("series", F.array("x1", "x2", "x3").alias("x"), "y")
    beta = linreg.least_squares(d, ["series"]).collect()[0]["beta"]
    ref = np.linalg.lstsq(np.column_stack([np.ones(len(y)), X]), y, rcond=None)[0]
    assert np.allclose(beta, ref, atol=1e-8)


def test_collinear_predictions_equal_reduced_fit(spark):
    df, X, y, _, _ = _data(spark, collinear=True)
    full = df.select("series", F.array("x1", "x2", "x3").alias("x"), "y")
    red = df.select("series", F.array("x1", "x2").alias("x"), "y")
    cf = linreg.least_squares(full, ["series"])
    cr = linreg.least_squares(red, ["series"])
    pf = [r["pred"] for r in linreg.predict(full, cf, ["series"]).select("pred").collect()]
    pr = [r["pred"] for r in linreg.predict(red, cr, ["series"]).select("pred").collect()]
    assert np.allclose(pf, pr, atol=1e-6)
    assert cf.collect()[0]["rank"] == 3


def test_expanding_folds_equal_direct_refit(spark):
    df, X, y, year, _ = _data(spark)
    u = df.withColumnRenamed("y", "price").withColumn("week_ending", F.lit(None).cast("date")) \
          .withColumn("price_lag1", F.lit(0.0)).withColumn("volume", F.lit(0.0)) \
          .withColumn("volume_lag1", F.lit(0.0)).withColumn("coverage", F.lit(0.0))
    spec = B.ModelSpec("m", ("x1", "x2", "x3"), "price")
    preds = B.ols_backtest(u, [spec]).toPandas()
    years = sorted(set(year))
    for t in years[4:]:
        tr = year < t
        A = np.column_stack([np.ones(tr.sum()), X[tr]])
        b = np.linalg.lstsq(A, y[tr], rcond=None)[0]
        te = year == t
        exp = np.column_stack([np.ones(te.sum()), X[te]]) @ b
        got = preds[preds.year == t].sort_values("actual")
        exp_sorted = exp[np.argsort(y[te])]
        assert np.allclose(got["pred_level"].to_numpy(), exp_sorted, atol=1e-8)


def _numpy_inference(X, y, groups=None):
    A = np.column_stack([np.ones(len(y)), X])
    n, k = A.shape
    b = np.linalg.lstsq(A, y, rcond=None)[0]
    e = y - A @ b
    bread = np.linalg.inv(A.T @ A)
    if groups is None:
        meat = (A * e[:, None] ** 2).T @ A
        v = bread @ meat @ bread * n / (n - k)
    else:
        gs = np.unique(groups)
        u = np.array([(A[groups == g] * e[groups == g, None]).sum(0) for g in gs])
        G = len(gs)
        v = bread @ (u.T @ u) @ bread * (G / (G - 1)) * ((n - 1) / (n - k))
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    return b, np.sqrt(np.diag(v)), r2, math.sqrt(e @ e / (n - k))


@pytest.mark.parametrize("cov", ["HC1", "cluster"])
def test_inference_matches_numpy(spark, cov):
    df, X, y, _, g = _data(spark)
    spec = S.Spec("s", "y", ("x1", "x2", "x3"))
    coefs, fit = S.fit_specs(spark, df, [spec], ["series"], [("S",)], cov=cov,
                             cluster="g" if cov == "cluster" else None)
    c = coefs.toPandas().sort_values("idx")
    f = fit.collect()[0]
    b, se, r2, rmse = _numpy_inference(X, y, g if cov == "cluster" else None)
    assert np.allclose(c["coef"], b, atol=1e-8)
    assert np.allclose(c["se"], se, rtol=1e-6)
    assert f["r2"] == pytest.approx(r2) and f["rmse"] == pytest.approx(rmse)
    z = b / se
    p = [math.erfc(abs(v) / math.sqrt(2)) for v in z]
    assert np.allclose(c["p"], p, atol=1e-10)
    assert list(c["term"]) == ["const", "x1", "x2", "x3"]


def test_residuals_orthogonal(spark):
    df, X, y, _, _ = _data(spark)
    d = df.select("series", F.array("x1", "x2", "x3").alias("x"), "y")
    c = linreg.least_squares(d, ["series"])
    p = linreg.predict(d, c, ["series"]).withColumn("e", F.col("y") - F.col("pred"))
    r = p.agg(F.sum("e"), F.sum(F.col("e") * F.col("x")[0])).collect()[0]
    assert abs(r[0]) < 1e-8 and abs(r[1]) < 1e-6


def test_rolling_folds_equal_direct_refit(spark):
    df, X, y, year, _ = _data(spark, n=200)
    u = df.withColumnRenamed("y", "price").withColumn("week_ending", F.lit(None).cast("date")) \
          .withColumn("price_lag1", F.lit(0.0)).withColumn("volume", F.lit(0.0)) \
          .withColumn("volume_lag1", F.lit(0.0)).withColumn("coverage", F.lit(0.0))
    spec = B.ModelSpec("m", ("x1", "x2", "x3"), "price")
    preds = B.ols_backtest(u, [spec], mode="rolling", window_years=5).toPandas()
    years = sorted(set(year))
    for t in years[4:]:
        tr = (year >= t - 5) & (year < t)
        A = np.column_stack([np.ones(tr.sum()), X[tr]])
        b = np.linalg.lstsq(A, y[tr], rcond=None)[0]
        te = year == t
        exp = (np.column_stack([np.ones(te.sum()), X[te]]) @ b)[np.argsort(y[te])]
        got = preds[preds.year == t].sort_values("actual")["pred_level"].to_numpy()
        assert np.allclose(got, exp, atol=1e-8)
        assert (preds[preds.year == t]["n_train"] == tr.sum()).all()


@pytest.mark.parametrize("factor", [1.0, 100.0, 1e4])
@pytest.mark.parametrize("cov", ["HC1", "cluster"])
@pytest.mark.parametrize("shape", ["plain", "near", "exact"])
def test_standard_errors_of_many_badly_scaled_terms(spark, factor, cov, shape):
    """23 terms from 1e-3 to 1e6 against NumPy on scaled columns."""
    rng = np.random.default_rng(11)
    n, k = 400, 23
    size = np.logspace(-3, 5, k)
    size[3] *= factor
    X = (rng.normal(0, 1, (n, k)) + rng.normal(3, 2, k)) * size
    X[:, 5] = (rng.random(n) < 0.2).astype(float)
    if shape != "plain":
        X[:, 7] = 2.0 * X[:, 6] + (size[6] * rng.normal(0, 1e-2, n) if shape == "near" else 0.0)
    g = rng.integers(0, 15, n)
    y = X @ (rng.normal(0, 1, k) / size) + rng.normal(0, 1, n) * (1 + np.abs(X[:, 0] / size[0]))
    df = spark.createDataFrame([("S", int(c), [float(v) for v in row], float(t)) for c, row, t in zip(g, X, y)],
                               "series string, g int, x array<double>, y double")
    terms = spark.createDataFrame([("S", i, f"t{i}") for i in range(k + 1)], "series string, idx int, term string")
    coef, fit = linreg.inference(df, ["series"], terms, cov=cov, cluster="g" if cov == "cluster" else None)
    got = {r["idx"]: (r["coef"], r["se"]) for r in coef.collect()}
    Z = np.column_stack([np.ones(n), (X - X.mean(0)) / X.std(0)])
    bread = np.linalg.pinv(Z.T @ Z, rcond=1e-9)
    b = bread @ Z.T @ y
    e = y - Z @ b
    rank = k + 1 - (shape == "exact")
    if cov == "HC1":
        meat, scale = (Z * (e ** 2)[:, None]).T @ Z, n / (n - rank)
    else:
        u = np.array([Z[g == c].T @ e[g == c] for c in np.unique(g)])
        meat, scale = u.T @ u, len(u) / (len(u) - 1) * (n - 1) / (n - rank)
    back = np.diag(np.concatenate([[1.0], 1 / X.std(0)]))
    back[0, 1:] = -X.mean(0) / X.std(0)
    se = np.sqrt(np.diag(back @ bread @ meat @ bread @ back.T * scale))
    assert fit.first()["k"] == rank
    assert np.allclose([got[i][1] for i in range(k + 1)], se, rtol=1e-6)
    assert np.allclose([got[i][0] for i in range(k + 1)], back @ b, rtol=1e-5)


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_moments_keep_their_digits_at_large_offsets(spark, offset):
    df, X, y, year, _ = _data(spark, n=400)
    shifted = df.select("series", "year", F.array(F.col("x1") + offset, F.col("x2") - offset, "x3", F.lit(7.3)).alias("x"), "y").repartition(7)
    got = linreg.least_squares(shifted, ["series"]).collect()[0]
    Z = np.column_stack([X[:, 0] + offset, X[:, 1] - offset, X[:, 2]])
    ref = np.linalg.lstsq(Z - Z.mean(axis=0), y - y.mean(), rcond=None)[0]
    assert np.allclose(got["beta"][1:4], ref, rtol=1e-8, atol=1e-8)
    assert got["beta"][4] == 0.0 and got["rank"] == 4
    assert got["n"] == 400 and got["sst"] == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-12)
    by_qr = linreg.least_squares(shifted, ["series"], method="qr").collect()[0]
    assert np.allclose(by_qr["beta"][1:4], ref, rtol=1e-7, atol=1e-7)
    assert by_qr["beta"][4] == 0.0 and by_qr["rank"] == 4


def test_merged_moments_equal_those_of_all_rows():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 4)) * [1, 1e3, 1e-3, 1] + [0, 1e6, 5, 1e8]
    total = None
    for part in np.array_split(v, [3, 4, 100, 350]):
        total = linreg.merge_moments(total, linreg.row_moments(part))
    n, mean, c = total
    d = v - v.mean(axis=0)
    assert n == 500 and np.allclose(mean, v.mean(axis=0), rtol=1e-15)
    assert np.allclose(c, d.T @ d, rtol=1e-7, atol=1e-9 * np.sqrt(np.outer(*[np.diag(d.T @ d)] * 2)).max())


@pytest.mark.parametrize("condition", [1e4, 1e9])
def test_r_factors_resolve_what_moments_cannot(spark, condition):
    rng = np.random.default_rng(9)
    n, p = 600, 5
    u, _ = np.linalg.qr(rng.normal(size=(n, p)))
    w, _ = np.linalg.qr(rng.normal(size=(p, p)))
    X = (u * np.geomspace(1, 1 / condition, p)) @ w
    beta = rng.normal(size=p)
    y = X @ beta
    rows = spark.createDataFrame([("a" if i % 3 else "b", X[i].tolist(), float(y[i])) for i in range(n)], "g string, x array<double>, y double")
    for r in linreg.least_squares(rows.repartition(6), ["g"], method="qr").collect():
        own = np.array([(i % 3 != 0) == (r["g"] == "a") for i in range(n)])
        A = np.column_stack([np.ones(own.sum()), X[own]])
        ref = np.linalg.lstsq(A, y[own], rcond=None)[0]
        assert r["rank"] == p + 1 and r["n"] == own.sum()
        assert np.allclose(A @ r["beta"], A @ ref, rtol=1e-6, atol=1e-9)
        assert np.allclose(r["beta"], ref, rtol=1e-6, atol=1e-6)


def test_r_factor_of_few_and_collinear_rows(spark):
    rows = [("few", [1.0, 2.0, 3.0], 1.0), ("few", [2.0, 1.0, 3.0], 2.0)]
    rows += [("col", [float(i), 2.0 * i, 1.0], 3.0 * i + 1) for i in range(20)]
    got = {r["g"]: r for r in linreg.least_squares(spark.createDataFrame(rows, "g string, x array<double>, y double"), ["g"], method="qr").collect()}
    assert got["few"]["n"] == 2 and got["few"]["rank"] == 2
    assert got["col"]["rank"] == 2
    assert np.allclose([got["col"]["beta"][0] + got["col"]["beta"][1] * i + got["col"]["beta"][2] * 2 * i for i in range(20)],
                       [3.0 * i + 1 for i in range(20)])


def test_models_share_one_pass_over_the_rows(spark):
    df, X, y, year, _ = _data(spark, n=200)
    u = df.withColumnRenamed("y", "price").withColumns({c: F.lit(0.0) for c in ("price_lag1", "volume", "volume_lag1", "coverage")}) \
          .withColumn("week_ending", F.lit(None).cast("date"))
    specs = [B.ModelSpec("all", ("x1", "x2", "x3"), "price"), B.ModelSpec("two", ("x3", "x1"), "price"), B.ModelSpec("mean", (), "price")]
    preds = B.ols_backtest(u, specs)
    plan = preds._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    got = preds.toPandas()
    for spec, cols in zip(specs, ([0, 1, 2], [2, 0], []), strict=True):
        for t in sorted(set(year))[4:]:
            tr, te = year < t, year == t
            b = np.linalg.lstsq(np.column_stack([np.ones(tr.sum()), X[tr][:, cols]]), y[tr], rcond=None)[0]
            want = np.column_stack([np.ones(te.sum()), X[te][:, cols]]) @ b
            own = got[(got.model == spec.name) & (got.year == t)].sort_values("actual")
            assert np.allclose(own["pred_level"], want[np.argsort(y[te])], atol=1e-8)
