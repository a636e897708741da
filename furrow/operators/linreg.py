"""Least squares as distributed sufficient statistics.

Design rows carry group keys, a feature vector ``x`` (array<double>) and a
target ``y``. Three kinds of statistics, each a few numbers a group and task:

* ``moments``: count, means and centred products of a vector column. Each task
  folds its batches pairwise, tasks are merged in two levels, and years merge
  the same way (``solve_folds``): no sum of raw squares is ever taken, so large
  offsets cost no digits. One pass over the union of all models' columns serves
  every model and fold: each picks its rows and columns of the merged matrix.
* ``gram``: sums of Z'Z for Z = [1, x, y], optionally weighted, on standardised
  columns (``inference``: the meat of the robust covariance).
* ``tsqr``: each task's R factor of [1, x, y], merged by stacking: the condition
  number is not squared, for designs that moments cannot resolve.

Solves use one relative cut-off (rank-deficient designs are safe and the rank
is reported). Only p x p matrices and coefficient vectors ever reach Python in
one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.session import materialize

RCOND = 1e-10
QR_RCOND = 1e-13
CONSTANT = 1e-13      # a spread of this share of the mean is rounding: a constant column
MERGE_FAN = 256       # first-level groups that the tasks' statistics of a key are merged in


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


# ----------------------------------------------------------------- 1. Gram

def gram(design: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Upper triangle of Z'Z (Z = [1, x, y]) per group as (keys, i, j, s) rows.

    With ``weight`` each row's outer product is multiplied by that column
    (used for the White meat matrix with squared residuals).
    """
    keys = list(keys)
    fields = _key_fields(design, keys)
    schema = T.StructType(fields + [T.StructField("i", T.IntegerType()),
                                    T.StructField("j", T.IntegerType()),
                                    T.StructField("s", T.DoubleType())])
    cols = keys + ["x", "y"] + ([weight] if weight else [])

    def partial(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for gkey, g in pdf.groupby(keys, sort=False, dropna=False):
                gkey = gkey if isinstance(gkey, tuple) else (gkey,)
                xs = np.stack(g["x"].to_numpy()).astype(float)
                z = np.column_stack([np.ones(len(g)), xs, g["y"].to_numpy(dtype=float)])
                zw = z * g[weight].to_numpy(dtype=float)[:, None] if weight else z
                m = zw.T @ z
                acc[gkey] = acc.get(gkey, 0) + m
        for gkey, m in acc.items():
            iu, ju = np.triu_indices(m.shape[0])
            out = pd.DataFrame({k: [v] * len(iu) for k, v in zip(keys, gkey)})
            out["i"] = iu.astype("int32")
            out["j"] = ju.astype("int32")
            out["s"] = m[iu, ju]
            yield out

    parts = design.select(*cols).mapInPandas(partial, schema)
    return parts.groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))


# ------------------------------------------------------------- 2. moments

Moments = tuple[float, np.ndarray, np.ndarray]      # n, means, centred products


def merge_moments(a: Moments | None, b: Moments) -> Moments:
    """Moments of two disjoint sets of rows together."""
    if a is None or a[0] == 0:
        return b
    if b[0] == 0:
        return a
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def row_moments(v: np.ndarray) -> Moments:
    """Moments of the rows of ``v``."""
    start = v[0]
    mean = start + (v - start).mean(axis=0)
    d = v - mean
    off = d.mean(axis=0)          # what rounding left of the mean
    return float(len(v)), mean + off, d.T @ d - len(v) * np.outer(off, off)


def _partials(design: DataFrame, keys: Sequence[str], column: str, state: str, make, merge) -> DataFrame:
    """(keys, ``state``) with one row a key: ``make(rows)`` of each batch, merged within the
    task, then over tasks in two levels. A state is a list of double arrays."""
    keys = list(keys)
    fields = _key_fields(design, keys)
    schema = T.StructType([*fields, T.StructField("_part", T.IntegerType()),
                           T.StructField(state, T.ArrayType(T.ArrayType(T.DoubleType())))])

    def grouped(pdf):
        for key, rows in pdf.groupby(keys, sort=False, dropna=False):
            yield (key if isinstance(key, tuple) else (key,)), rows

    def partial(batches):
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, rows in (grouped(pdf) if len(pdf) else ()):
                new = make(np.stack(rows[column].to_numpy()).astype(float))
                held[key] = merge(held[key], new) if key in held else new
        if held:
            part = TaskContext.get().partitionId() % MERGE_FAN
            out = pd.DataFrame(list(held), columns=keys)
            out["_part"] = np.int32(part)
            out[state] = [[np.atleast_1d(x).ravel() for x in s] for s in held.values()]
            yield out

    def combine(pdf):
        total = None
        for s in pdf[state]:
            one = restore([np.asarray(x, dtype=float) for x in s])
            total = one if total is None else merge(total, one)
        out = pdf.iloc[:1].copy()
        out[state] = [[np.atleast_1d(x).ravel() for x in total]]
        return out

    restore = _RESTORE[state]
    parts = design.select(*keys, column).mapInPandas(partial, schema)
    first = parts.groupBy(*keys, "_part").applyInPandas(combine, schema)
    return first.groupBy(*keys).applyInPandas(combine, schema).drop("_part")


_RESTORE = {
    "moments": lambda s: (float(s[0][0]), s[1], s[2].reshape(len(s[1]), len(s[1]))),
    "r": lambda s: (float(s[0][0]), s[1].reshape(-1, int(math.isqrt(len(s[1]))))),
}


def moments(design: DataFrame, keys: Sequence[str], column: str = "v") -> DataFrame:
    """(keys, moments): count, means and centred products of the vectors in ``column``."""
    return _partials(design, keys, column, "moments", row_moments, merge_moments)


# ------------------------------------------------------------- 3. solve

def _decompose(sxx: np.ndarray, mean: np.ndarray, n: float):
    """Correlation-scaled decomposition of centred products: (usable columns, scales,
    generalised inverse of the correlations, number of directions kept). One cut-off
    serves coefficients, rank and standard errors, and doesn't depend on the features'
    magnitudes."""
    d = np.sqrt(np.clip(np.diag(sxx), 0, None))
    usable = d > np.abs(mean) * CONSTANT * math.sqrt(max(n, 1.0))
    scale = np.where(usable, d, 1.0)
    corr = np.where(np.outer(usable, usable), sxx / np.outer(scale, scale), 0.0)
    vals, vecs = np.linalg.eigh(corr)
    keep = vals > RCOND * max(vals.max(), 0.0) * len(d)
    inv = (vecs[:, keep] / vals[keep]) @ vecs[:, keep].T
    return usable, scale, inv, int(keep.sum())


def solve_moments(m: Moments, x: Sequence[int], y: int) -> tuple[np.ndarray, int, float]:
    """(beta incl. intercept, rank, centred sum of squares of y) of column ``y`` on columns ``x``."""
    n, mean, c = m
    x = list(x)
    if n <= 0:
        return np.full(len(x) + 1, np.nan), 0, np.nan
    if not x:
        return np.array([mean[y]]), 1, c[y, y]
    usable, scale, inv, kept = _decompose(c[np.ix_(x, x)], mean[x], n)
    b = np.where(usable, (inv @ (c[x, y] / scale)) / scale, 0.0)
    return np.concatenate([[mean[y] - mean[x] @ b], b]), kept + 1, c[y, y]


def _centred(g: np.ndarray) -> Moments:
    """Moments from a Gram of [1, x, y] (of standardised columns, where nothing is lost)."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, mean, g[1:, 1:] - n * np.outer(mean, mean)


def _bread(g: np.ndarray) -> np.ndarray:
    """(X'X)^- of [1, x] from the same decomposition as the coefficients."""
    p = g.shape[0] - 1
    n, mean, c = _centred(g)
    if p == 1:
        return np.array([[1.0 / n]])
    mx = mean[:-1]
    _, scale, inv, _ = _decompose(c[:-1, :-1], mx, n)
    slope = inv / np.outer(scale, scale)
    out = np.empty((p, p))
    out[1:, 1:] = slope
    out[0, 1:] = out[1:, 0] = -mx @ slope
    out[0, 0] = 1.0 / n + mx @ slope @ mx
    return out


def _full(pdf: pd.DataFrame) -> np.ndarray:
    size = int(max(pdf["i"].max(), pdf["j"].max())) + 1
    g = np.zeros((size, size))
    i = pdf["i"].to_numpy()
    j = pdf["j"].to_numpy()
    s = pdf["s"].to_numpy(dtype=float)
    g[i, j] = s
    g[j, i] = s
    return g


_SOLUTION = [T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("rank", T.IntegerType()),
             T.StructField("n", T.LongType()), T.StructField("sst", T.DoubleType())]


def _solution(beta, rank, n, sst) -> dict:
    return dict(beta=[float(v) for v in beta], rank=int(rank), n=int(round(n)), sst=float(sst))


def least_squares(design: DataFrame, keys: Sequence[str], method: str = "moments") -> DataFrame:
    """Least squares of ``y`` on ``x`` per group: (keys, beta array<double>, rank, n, sst).
    ``method='qr'`` is slower and resolves condition numbers up to about 1e12."""
    keys = list(keys)
    rows = design.select(*keys, F.concat("x", F.array(F.col("y").cast("double"))).alias("v"))
    if method == "qr":
        parts = tsqr(rows, keys)
        solve_one = _solve_r
    else:
        parts = moments(rows, keys)
        solve_one = _solve_last
    state = "r" if method == "qr" else "moments"

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _RESTORE[state]([np.asarray(x, dtype=float) for x in pdf[state].iloc[0]])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **_solution(*solve_one(s))}])

    return parts.groupBy(*keys).applyInPandas(solved, T.StructType(_key_fields(design, keys) + _SOLUTION))


def _solve_grams(grams: DataFrame, keys: list[str]) -> DataFrame:
    """``least_squares`` from the ``gram`` of standardised columns."""
    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **_solution(*_solve_last(_centred(_full(pdf))))}])

    return grams.groupBy(*keys).applyInPandas(solved, T.StructType(_key_fields(grams, keys) + _SOLUTION))


def _solve_last(m: Moments):
    p = len(m[1]) - 1
    beta, rank, sst = solve_moments(m, range(p), p)
    return beta, rank, m[0], sst


def solve_folds(yearly: DataFrame, keys: Sequence[str], folds: DataFrame, models: Sequence[tuple[str, Sequence[int], int]],
                mode: str = "expanding", window_years: int = 5) -> DataFrame:
    """(keys, model, fold, beta, rank, n, sst) from yearly ``moments`` over all models' columns.

    ``folds`` holds (keys, fold): the test years. Fold t is trained on the years before t (all
    of them, or the last ``window_years`` for ``mode='rolling'``), whose moments are merged;
    a model (name, x, y) takes columns ``x`` and ``y`` of the merged matrix. A group holds one
    small matrix a year."""
    keys = list(keys)
    tests = folds.groupBy(*keys).agg(F.sort_array(F.collect_list("fold")).alias("_folds"))
    fields = _key_fields(yearly, keys)
    schema = T.StructType([*fields, T.StructField("model", T.StringType()), T.StructField("fold", yearly.schema["year"].dataType), *_SOLUTION])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        years = {int(y): _RESTORE["moments"]([np.asarray(x, dtype=float) for x in s]) for y, s in zip(pdf["year"], pdf["moments"])}
        first = {k: pdf[k].iloc[0] for k in keys}
        rows = []
        for fold in map(int, pdf["_folds"].iloc[0]):
            total = None
            for y in sorted(years):
                if y < fold and (mode == "expanding" or y >= fold - window_years):
                    total = merge_moments(total, years[y])
            if total is None:
                continue
            for name, x, y in models:
                beta, rank, sst = solve_moments(total, x, y)
                rows.append({**first, "model": name, "fold": fold, **_solution(beta, rank, total[0], sst)})
        return pd.DataFrame(rows, columns=schema.names)

    return yearly.join(F.broadcast(tests), keys).groupBy(*keys).applyInPandas(solved, schema)


# -------------------------------------------------------------- 4. R factors

def _r_factor(v: np.ndarray) -> tuple[float, np.ndarray]:
    """(rows, R) of [1, v]."""
    return float(len(v)), _triangle(np.column_stack([np.ones(len(v)), v]))


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Square R factor; zero rows where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def tsqr(design: DataFrame, keys: Sequence[str], column: str = "v") -> DataFrame:
    """(keys, r): count and R factor of the rows [1, ``column``], merged by stacking."""
    return _partials(design, keys, column, "r", _r_factor, lambda a, b: (a[0] + b[0], _triangle(np.vstack([a[1], b[1]]))))


def _solve_r(state: tuple[float, np.ndarray]):
    """(beta, rank, n, sst) of the last column on the others, from the R factor of [1, x, y].
    Below the first row, R is that of the centred columns."""
    n, r = state
    p = len(r) - 2
    means = r[0, 1:] / r[0, 0]
    a, t = r[1:, 1:-1], r[1:, -1]
    d = np.sqrt((a * a).sum(axis=0))
    usable = d > np.abs(means[:-1]) * CONSTANT * math.sqrt(max(n, 1.0))
    scale = np.where(usable, d, 1.0)
    u, s, vt = np.linalg.svd(np.where(usable, a / scale, 0.0), full_matrices=False)
    keep = s > QR_RCOND * (s[0] if len(s) else 0.0) * max(p, 1)
    b = (vt[keep].T @ ((u[:, keep].T @ t) / s[keep])) / scale if p else np.zeros(0)
    return np.concatenate([[means[-1] - means[:-1] @ b], b]), int(keep.sum()) + 1, n, float(t @ t)


# ----------------------------------------------------------- prediction

def linear_predict(beta: str = "beta", x: str = "x"):
    """beta[0] + sum(beta[1:] * x) as a JVM-side expression."""
    b = F.col(beta)
    terms = F.zip_with(F.slice(b, 2, F.size(b) - 1), F.col(x), lambda bi, xi: bi * xi)
    return b[0] + F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def predict(design: DataFrame, coefs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach ``pred`` to design rows. ``coefs`` has one row per model/fold
    (bounded by the model registry size x folds), so it is broadcast."""
    return (design.join(F.broadcast(coefs.select(*on, "beta")), list(on), "inner")
                  .withColumn("pred", linear_predict()))


# ------------------------------------------------------------ inference

def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0)) if np.isfinite(z) else float("nan")


def standardised(design: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(design with each group's features centred and scaled, the (keys, _mean,
    _scale) used). The sums that follow then keep their digits whatever the
    features' magnitudes and the number of rows. Constant features become 0."""
    keys = list(keys)
    by_feature = (design.select(*keys, F.posexplode("x").alias("i", "v")).groupBy(*keys, "i")
                  .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")))
    # A spread that is only rounding of the mean is a constant feature.
    usable = F.col("s") > F.abs("m") * F.lit(1e-13)
    lists = by_feature.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "i", "m", F.when(usable, F.col("s")).otherwise(F.lit(1.0)).alias("s"), usable.alias("ok")))).alias("_f"))
    lists = lists.select(*keys, "_f", F.transform("_f", lambda f: f["m"]).alias("_mean"),
                         F.transform("_f", lambda f: f["s"]).alias("_scale"))
    out = design.join(lists.select(*keys, "_f"), keys).withColumn(
        "x", F.zip_with("x", "_f", lambda v, f: F.when(f["ok"], (v - f["m"]) / f["s"]).otherwise(F.lit(0.0)))).drop("_f")
    return out, lists.select(*keys, "_mean", "_scale")


def inference(design: DataFrame, keys: Sequence[str], terms: DataFrame,
              cov: str = "HC1", cluster: str | None = None) -> tuple[DataFrame, DataFrame]:
    """In-sample OLS with robust standard errors.

    Returns (coefficients, fit): coefficients (keys, term, coef, se, z, p)
    and fit statistics (keys, nobs, k, r2, adj_r2, rmse, n_clusters,
    few_clusters = 1 when clustered errors rest on fewer than 10 clusters).
    ``cov='HC1'``: White sandwich scaled by n/(n-k). ``cov='cluster'``:
    scores summed per ``cluster`` value, scaled by G/(G-1)*(n-1)/(n-k).
    ``terms`` maps (keys..., idx) -> term name, idx 0 = const.
    """
    keys = list(keys)
    # Several passes follow: cut the lineage so that none rebuilds the modelling set.
    design, shifts = standardised(materialize(design), keys)
    g_raw = gram(design, keys)
    coefs = _solve_grams(g_raw, keys)
    scored = (design.join(F.broadcast(coefs.select(*keys, "beta")), keys)
                    .withColumn("e", F.col("y") - linear_predict()))
    if cov == "cluster":
        # Per-cluster score sums u_g = sum_i z_i e_i are sums in the JVM; a cluster's
        # vector (p numbers) then adds its outer product to the meat, in vectorised
        # partial sums per group: no state per cluster, no p x p rows per cluster.
        z = F.concat(F.array(F.lit(1.0)), F.col("x"))
        scores = scored.select(*keys, F.col(cluster).cast("string").alias("_g"),
                               F.posexplode(F.transform(z, lambda v: v * F.col("e"))).alias("i", "s"))
        sums = scores.groupBy(*keys, "_g", "i").agg(F.sum("s").alias("s"))
        cg = sums.groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("u"))
        vectors = cg.select(*keys, F.transform("u", lambda v: v["s"]).alias("x"), F.lit(0.0).alias("y"))
        meat = (gram(vectors, keys).where(F.col("i") >= 1)
                .select(*keys, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "s"))
        n_clusters = cg.groupBy(*keys).agg(F.countDistinct("_g").cast("int").alias("_G"))
    else:
        meat = gram(scored.withColumn("w", F.col("e") * F.col("e")), keys, weight="w")
        n_clusters = None
    ssr = scored.groupBy(*keys).agg(F.sum(F.col("e") * F.col("e")).alias("ssr"))
    if n_clusters is not None:
        ssr = ssr.join(n_clusters, keys)
    else:
        ssr = ssr.withColumn("_G", F.lit(0))

    # Per group: Gram (tag 'g') and meat (tag 'm'), both p x p sized.
    g_all = g_raw.select(*keys, F.lit("g").alias("tag"), "i", "j", "s")
    m_all = meat.select(*keys, F.lit("m").alias("tag"), "i", "j", "s")
    parts = g_all.unionByName(m_all).join(ssr, keys).join(shifts, keys)
    fields = _key_fields(design, keys)
    coef_schema = T.StructType(fields + [
        T.StructField("idx", T.IntegerType()), T.StructField("coef", T.DoubleType()),
        T.StructField("se", T.DoubleType()), T.StructField("z", T.DoubleType()),
        T.StructField("p", T.DoubleType()), T.StructField("nobs", T.LongType()),
        T.StructField("k", T.IntegerType()), T.StructField("r2", T.DoubleType()),
        T.StructField("adj_r2", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
        T.StructField("n_clusters", T.IntegerType()),
    ])

    def sandwich(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _full(pdf[pdf.tag == "g"])
        p = g.shape[0] - 1
        beta, rank, sst = solve_moments(_centred(g), range(p - 1), p - 1)
        n = g[0, 0]
        bread = _bread(g)
        ssr_v = float(pdf["ssr"].iloc[0])
        dof = n - rank
        n_cl = int(pdf["_G"].iloc[0])
        m = pdf[(pdf.tag == "m") & (pdf.i < p) & (pdf.j < p)]  # drop the target's row/column
        meat_m = np.zeros((p, p))
        meat_m[m["i"].to_numpy(), m["j"].to_numpy()] = m["s"].to_numpy(dtype=float)
        meat_m[m["j"].to_numpy(), m["i"].to_numpy()] = m["s"].to_numpy(dtype=float)
        if cov == "cluster":
            factor = (n_cl / (n_cl - 1.0)) * ((n - 1.0) / dof) if n_cl > 1 and dof > 0 else np.nan
        else:
            factor = n / dof if dof > 0 else np.nan
        # Back from standardised features: b_i / scale_i, and the intercept less their means.
        mean, scale = (np.array(pdf[c].iloc[0], dtype=float) for c in ("_mean", "_scale"))
        back = np.zeros((p, p))
        back[0, 0] = 1.0
        back[np.arange(1, p), np.arange(1, p)] = 1.0 / scale
        back[0, 1:] = -mean / scale
        beta = back @ beta
        v = back @ (bread @ meat_m @ bread * factor) @ back.T
        se = np.sqrt(np.clip(np.diag(v), 0, None))
        r2 = 1 - ssr_v / sst if sst > 0 else np.nan
        adj = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else np.nan
        rmse = math.sqrt(ssr_v / dof) if dof > 0 else np.nan
        rows = []
        base = {k: pdf[k].iloc[0] for k in keys}
        for idx in range(p):
            z = beta[idx] / se[idx] if se[idx] > 0 else np.nan
            rows.append({**base, "idx": idx, "coef": float(beta[idx]), "se": float(se[idx]),
                         "z": float(z), "p": _normal_p(z), "nobs": int(round(n)), "k": int(rank),
                         "r2": float(r2), "adj_r2": float(adj), "rmse": float(rmse),
                         "n_clusters": n_cl})
        return pd.DataFrame(rows)

    out = parts.groupBy(*keys).applyInPandas(sandwich, coef_schema)
    out = out.join(F.broadcast(terms), keys + ["idx"], "left")
    coef_tbl = out.select(*keys, "idx", "term", "coef", "se", "z", "p")
    # With few clusters the clustered covariance has rank <= G - 1: flag G < 10.
    few = (F.lit(cov == "cluster") & (F.col("n_clusters") < 10)).cast("int")
    fit = (out.where(F.col("idx") == 0)
              .select(*keys, "nobs", "k", "r2", "adj_r2", "rmse", "n_clusters",
                      few.alias("few_clusters")))
    return coef_tbl, fit
