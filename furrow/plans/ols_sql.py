"""Least squares as DuckDB SQL, for the oracles of the models with many regressors.

From a CTE of rows (g, rid, y, x: list of regressors, cl: cluster) the fragments work out,
per group g: centred, scaled columns; the correlation matrix and right-hand side as one list
of lists; its inverse by the sweep operator, one pivot a step of a recursive CTE. A pivot
without variance left marks a collinear column and its null vector; adding the null vectors'
outer products makes the matrix regular, and a second sweep gives the least-norm solution in
scaled columns. Robust errors are sums of squared influences (of rows, or of clusters).
"""

from __future__ import annotations

from collections.abc import Sequence

TOLERANCE = 1e-9      # variance share of a column that the columns before it leave unexplained
SERIES_TERMS = 160    # of the error function; enough up to ERF_END
ERF_END = 6.0


def rows_sql(source: str, label: str, target: str, features: Sequence[str], where: str = "TRUE", keys: str = "series",
             cluster: str = "NULL") -> str:
    """SELECT of the complete cases of one model as (keys, g, rid, y, x, cl)."""
    full = " AND ".join(f"{c} IS NOT NULL" for c in [*features, target])
    x = ", ".join(f"CAST({c} AS DOUBLE)" for c in features)
    return (f"SELECT {keys}, {label} AS g, row_number() OVER () AS rid, CAST({target} AS DOUBLE) AS y, [{x}] AS x, "
            f"CAST({cluster} AS VARCHAR) AS cl FROM {source} WHERE ({where}) AND {full}")


def _sweep(name: str, start: str) -> str:
    """Recursive CTE ``name`` (g, p, m, skipped): all pivots of the matrices m of ``start``."""
    return f"""{name} AS (
  SELECT g, 1 AS p, m, CAST([] AS BIGINT[]) AS skipped FROM {start}
  UNION ALL
  SELECT g, p + 1,
         CASE WHEN m[p][p] <= {TOLERANCE} THEN m ELSE
           list_transform(m, lambda row, i: list_transform(row, lambda v, j:
             CASE WHEN i = p AND j = p THEN 1.0 / m[p][p] WHEN i = p THEN v / m[p][p]
                  WHEN j = p THEN -row[p] / m[p][p] ELSE v - row[p] * m[p][j] / m[p][p] END)) END,
         CASE WHEN m[p][p] <= {TOLERANCE} THEN list_append(skipped, p) ELSE skipped END
  FROM {name} WHERE p <= len(m))"""


def fit_ctes(p: str, rows: str) -> str:
    """CTEs ``{p}_mom`` (g, i, m, s, ok), ``{p}_n`` (g, n, ybar, rank), ``{p}_inv`` (g, b: inverse,
    beta: scaled slopes) and ``{p}_beta`` (g, b0, slopes) of the groups of ``rows``."""
    return f"""
{p}_long AS (SELECT g, rid, y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {rows}),
{p}_mom AS (
  SELECT g, i, m, CASE WHEN s > abs(m) * 1e-13 THEN s ELSE 1.0 END AS s, s > abs(m) * 1e-13 AS ok
  FROM (SELECT g, i, avg(v) AS m, stddev_pop(v) AS s FROM {p}_long GROUP BY 1, 2)),
{p}_size AS (SELECT g, count(*) AS n, avg(y) AS ybar FROM {rows} GROUP BY 1),
{p}_std AS (
  SELECT l.g, l.rid, l.i, l.y - z.ybar AS yc, CASE WHEN ok THEN (l.v - m.m) / m.s ELSE 0.0 END AS z
  FROM {p}_long l JOIN {p}_mom m USING (g, i) JOIN {p}_size z USING (g)),
{p}_cell AS (
  SELECT a.g, a.i, b.i AS j, avg(a.z * b.z) AS r FROM {p}_std a JOIN {p}_std b USING (g, rid) GROUP BY 1, 2, 3
  UNION ALL SELECT g, i, 1000000, avg(z * yc) FROM {p}_std GROUP BY 1, 2),
{p}_line AS (SELECT g, i, list(r ORDER BY j) AS line FROM {p}_cell GROUP BY 1, 2),
{p}_first AS (SELECT g, list(line ORDER BY i) AS m FROM {p}_line GROUP BY 1),
{_sweep(f"{p}_swept", f"{p}_first")},
{p}_done AS (SELECT g, m, skipped FROM {p}_swept WHERE p = len(m) + 1),
{p}_null AS (
  SELECT g, list_transform(skipped, lambda k: list_transform(m, lambda row, i:
           CASE WHEN i = k THEN 1.0 WHEN list_contains(skipped, i) THEN 0.0 ELSE -row[k] END)) AS vectors
  FROM {p}_done),
{p}_second AS (
  SELECT f.g, list_transform(f.m, lambda row, i: list_transform(row, lambda v, j:
           CASE WHEN j > len(f.m) THEN v
                ELSE v + coalesce(list_sum(list_transform(u.vectors, lambda w: w[i] * w[j])), 0.0) END)) AS m
  FROM {p}_first f JOIN {p}_null u USING (g)),
{_sweep(f"{p}_again", f"{p}_second")},
{p}_inv AS (
  SELECT g, list_transform(m, lambda row: row[len(m) + 1]) AS beta, m AS b FROM {p}_again WHERE p = len(m) + 1),
{p}_n AS (
  SELECT z.*, len(d.m) - len(d.skipped) + 1 AS rank FROM {p}_size z JOIN {p}_done d USING (g)),
{p}_slope AS (SELECT m.g, m.i, m.m, m.s, i.beta[m.i] / m.s AS slope FROM {p}_mom m JOIN {p}_inv i USING (g)),
{p}_beta AS (
  SELECT s.g, any_value(z.ybar) - sum(s.slope * s.m) AS b0, list(s.slope ORDER BY s.i) AS slopes
  FROM {p}_slope s JOIN {p}_size z USING (g) GROUP BY 1)"""


PREDICT = "{b}.b0 + list_sum(list_transform(range(1, len({x}) + 1), lambda i: {b}.slopes[i] * {x}[i]))"


def predicted(b: str, x: str) -> str:
    return PREDICT.format(b=b, x=x)


def inference_ctes(p: str, rows: str, clustered: bool) -> str:
    """``fit_ctes`` and ``{p}_fit`` (g, nobs, k, r2, adj_r2, rmse, n_clusters, few_clusters),
    ``{p}_coef`` (g, idx, coef, se, z, p)."""
    unit = "coalesce(cl, '')" if clustered else "rid"
    factor = ("(c.n_clusters / (c.n_clusters - 1.0)) * ((n.n - 1.0) / (n.n - n.rank))" if clustered
              else "n.n / (n.n - n.rank)")
    few = "CASE WHEN c.n_clusters < 10 THEN 1 ELSE 0 END" if clustered else "0"
    count = "count(DISTINCT cl)" if clustered else "0"
    return fit_ctes(p, rows) + f""",
{p}_res AS (SELECT r.g, r.rid, r.cl, r.y - ({predicted("b", "r.x")}) AS e FROM {rows} r JOIN {p}_beta b USING (g)),
{p}_score AS (
  SELECT s.g, e.unit, s.i, sum(s.z * e.e) AS u
  FROM {p}_std s JOIN (SELECT g, rid, e, {unit} AS unit FROM {p}_res) e USING (g, rid) GROUP BY 1, 2, 3),
{p}_flat AS (
  SELECT g, generate_subscripts(b, 1) AS i, unnest(b) AS line FROM {p}_inv),
{p}_corr AS (SELECT g, i, list(r ORDER BY j) AS line FROM {p}_cell WHERE j < 1000000 GROUP BY 1, 2),
{p}_cells_b AS (SELECT g, i, unnest(line[1:-2]) AS v, generate_subscripts(line[1:-2], 1) AS j FROM {p}_flat),
{p}_cells_r AS (SELECT g, i, unnest(line) AS v, generate_subscripts(line, 1) AS j FROM {p}_corr),
{p}_br AS (SELECT a.g, a.i, b.j, sum(a.v * b.v) AS v FROM {p}_cells_b a JOIN {p}_cells_r b ON a.g = b.g AND a.j = b.i GROUP BY 1, 2, 3),
{p}_bread AS (SELECT a.g, a.i, b.j, sum(a.v * b.v) AS v FROM {p}_br a JOIN {p}_cells_b b ON a.g = b.g AND a.j = b.i GROUP BY 1, 2, 3),
{p}_inf AS (
  SELECT u.g, u.unit, b.i, sum(b.v * u.u) / any_value(n.n) / any_value(m.s) AS h, any_value(m.m) AS mean
  FROM {p}_score u JOIN {p}_bread b ON u.g = b.g AND u.i = b.j JOIN {p}_n n ON n.g = u.g
       JOIN {p}_mom m ON m.g = b.g AND m.i = b.i GROUP BY 1, 2, 3),
{p}_inf0 AS (
  SELECT i.g, i.unit, any_value(e.e) / any_value(n.n) - sum(i.h * i.mean) AS h
  FROM {p}_inf i JOIN (SELECT g, {unit} AS unit, sum(e) AS e FROM {p}_res GROUP BY 1, 2) e USING (g, unit) JOIN {p}_n n USING (g)
  GROUP BY 1, 2),
{p}_var AS (
  SELECT g, 0 AS idx, sum(h * h) AS v FROM {p}_inf0 GROUP BY 1
  UNION ALL SELECT g, i, sum(h * h) FROM {p}_inf GROUP BY 1, 2),
{p}_cl AS (SELECT g, {count} AS n_clusters, sum(e * e) AS ssr FROM {p}_res GROUP BY 1),
{p}_sst AS (SELECT r.g, sum((r.y - z.ybar) * (r.y - z.ybar)) AS sst FROM {rows} r JOIN {p}_size z USING (g) GROUP BY 1),
{p}_fit AS (
  SELECT n.g, n.n AS nobs, n.rank AS k, 1 - c.ssr / t.sst AS r2,
         1 - (c.ssr / t.sst) * (n.n - 1) / (n.n - n.rank) AS adj_r2, sqrt(c.ssr / (n.n - n.rank)) AS rmse,
         c.n_clusters, {few} AS few_clusters
  FROM {p}_n n JOIN {p}_cl c USING (g) JOIN {p}_sst t USING (g)),
{p}_all AS (
  SELECT g, 0 AS idx, b0 AS coef FROM {p}_beta UNION ALL SELECT g, i, slope FROM {p}_slope),
{p}_se AS (
  SELECT a.g, a.idx, a.coef, sqrt(greatest(v.v, 0) * {factor}) AS se
  FROM {p}_all a JOIN {p}_var v USING (g, idx) JOIN {p}_n n USING (g) JOIN {p}_cl c USING (g)),
{p}_z AS (SELECT *, CASE WHEN se > 0 THEN coef / se END AS z FROM {p}_se),
{p}_coef AS (
  SELECT g, idx, coef, se, z,
         CASE WHEN z IS NULL THEN NULL WHEN abs(z) / sqrt(2.0) > {ERF_END} THEN 0.0 WHEN z = 0 THEN 1.0
              ELSE 1 - list_sum(list_transform(range(0, {SERIES_TERMS}), lambda t:
                exp(-z * z / 2 + (2 * t + 1) * ln(abs(z) / sqrt(2.0)) - lgamma(t + 1.5)))) END AS p
  FROM {p}_z)"""


def stars_sql(p: str, levels: Sequence[tuple[float, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {p} < {bound} THEN '{mark}'" for bound, mark in levels) + " ELSE '' END"


def terms_sql(specs: Sequence[tuple[str, Sequence[str]]]) -> str:
    """VALUES of (spec, idx, term); index 0 is the constant."""
    rows = [f"('{name}', {i}, '{t}')" for name, features in specs for i, t in enumerate(["const", *features])]
    return "(VALUES " + ", ".join(rows) + ") AS terms(spec, idx, term)"
