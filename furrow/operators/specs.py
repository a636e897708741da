"""In-sample regression specifications and coefficient tables.

A specification is (name, target, features, covariance). ``fit_specs`` stacks
every specification's design rows (each with its own complete cases) and
runs one distributed Gram / sandwich pass for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import config as K
from furrow.functions.columns import flag, month_in, safe_log, stars, transition_week
from furrow.operators import linreg


@dataclass(frozen=True)
class Spec:
    name: str
    target: str
    features: tuple[str, ...]
    where: str | None = None  # optional SQL filter, e.g. "price > 0"


def baseline_specs() -> list[Spec]:
    """M5: weather only; weather + lags + calendar; log price."""
    return [
        Spec("1. Weather only", "price", tuple(K.BASELINE_SPEC_1)),
        Spec("2. Weather + Lags + Calendar", "price", tuple(K.BASELINE_SPEC_2)),
        Spec("3. Log(Price) + Lags + Calendar", "log_price", tuple(K.BASELINE_SPEC_2), "price > 0"),
    ]


def district_specs() -> list[Spec]:
    """M6: five district panel specifications."""
    w, fe, se, ia = K.WEATHER_NOW, ["d_az", "d_third"], K.DISTRICT_SEASON, K.DISTRICT_INTERACT
    mv, wl, tr = K.DISTRICT_MARKET, K.DISTRICT_WEATHER_LAGS, K.DISTRICT_TRANSITION
    return [
        Spec("M1 dprice", "dprice", tuple(w + fe + se + ia)),
        Spec("M2 dprice+volume", "dprice", tuple(w + fe + se + ia + mv)),
        Spec("M3 dprice+weather lags", "dprice", tuple(w + wl + fe + se + ia + mv)),
        Spec("M4 level", "price", tuple(w + wl + K.PRICE_LAGS + fe + se + ia + mv)),
        Spec("M5 transition", "dprice", tuple(w + fe + se + ia + mv + tr)),
    ]


def volume_specs() -> list[Spec]:
    """M7: volume level and volume change, in sample."""
    return [
        Spec("Volume level", "volume", tuple(K.VOLUME_LEVEL_FEATURES)),
        Spec("Volume change", "dvolume", tuple(K.VOLUME_CHANGE_FEATURES)),
    ]


def variety_specs() -> list[Spec]:
    """Level and change models without the active-district count."""
    level = K.WEATHER_NOW + K.BASE_LAGS + K.BASE_ROLLING + K.BASE_CALENDAR + ["coverage"]
    change = [f for f in level if "price_lag" not in f]
    return [Spec("Level", "price", tuple(level)), Spec("Change", "dprice", tuple(change))]


def district_design(dist: DataFrame, cfg) -> DataFrame:
    """Adds Δprice, district dummies, quarters, interactions, transition terms."""
    core = list(cfg.core_districts)
    d_az = flag(F.col("district") == core[1])
    d_third = flag(F.col("district") == core[2])
    q = {name: month_in("month", months) for name, months in K.QUARTER_MONTHS.items()}
    tw = transition_week("week_of_year", K.TRANSITION_WEEKS)
    return dist.select(
        "*",
        (F.col("price") - F.col("price_lag1")).alias("dprice"),
        (F.col("volume") - F.col("volume_lag1")).alias("volume_change"),
        d_az.alias("d_az"), d_third.alias("d_third"),
        *[c.alias(n) for n, c in q.items()],
        (d_az * q["q1"]).alias("az_winter"), (d_az * q["q2"]).alias("az_spring"),
        tw.alias("transition_week"),
        (F.col("dd_freeze") * tw).alias("freeze_x_transition"),
        (F.col("dd_heat") * tw).alias("heat_x_transition"),
        (F.col("ppt_total") * tw).alias("ppt_x_transition"),
    )


def with_log_price(m: DataFrame) -> DataFrame:
    return m.withColumn("log_price", safe_log("price"))


def stacked_design(df: DataFrame, specs: Sequence[Spec], keys: Sequence[str],
                   extra: Sequence[str] = ()) -> DataFrame:
    """Each spec's complete cases as design rows tagged with ``spec``."""
    parts = []
    for s in specs:
        d = df.where(s.where) if s.where else df
        d = d.na.drop(subset=list(dict.fromkeys(list(s.features) + [s.target])))
        x = F.array(*[F.col(c).cast("double") for c in s.features])
        parts.append(d.select(*keys, F.lit(s.name).alias("spec"), x.alias("x"),
                              F.col(s.target).cast("double").alias("y"), *extra))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def term_table(spark: SparkSession, specs: Sequence[Spec], key_rows: Sequence[tuple],
               key_names: Sequence[str]) -> DataFrame:
    """(keys..., spec, idx, term) for every spec; idx 0 is the intercept.

    The table size is fixed by the specification registry."""
    rows = []
    for kr in key_rows:
        for s in specs:
            for i, t in enumerate(("const",) + tuple(s.features)):
                rows.append(tuple(kr) + (s.name, i, t))
    schema = ", ".join(f"{k} string" for k in key_names) + ", spec string, idx int, term string"
    return F.broadcast(spark.createDataFrame(rows, schema))


def fit_specs(spark: SparkSession, df: DataFrame, specs: Sequence[Spec], keys: Sequence[str],
              key_values: Sequence[tuple], cov: str = "HC1",
              cluster: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Coefficient table with stars and fit table for all specs at once."""
    keys = list(keys)
    extra = [cluster] if cluster else []
    design = stacked_design(df, specs, keys, extra)
    terms = term_table(spark, specs, key_values, keys)
    coefs, fit = linreg.inference(design, keys + ["spec"], terms, cov=cov, cluster=cluster)
    return coefs.withColumn("stars", stars("p", K.STARS)), fit


def compare_coefficients(a: DataFrame, b: DataFrame, on: Sequence[str], names=("a", "b"),
                         terms: Sequence[str] | None = None) -> DataFrame:
    """Two coefficient tables side by side on the term with a same-sign test."""
    na, nb = names
    sel = lambda t, n: t.select(*on, "term", F.col("coef").alias(f"{n}_coef"),
                                F.col("p").alias(f"{n}_p"), F.col("stars").alias(f"{n}_stars"))
    j = sel(a, na).join(sel(b, nb), list(on) + ["term"], "full")
    if terms is not None:
        j = j.where(F.col("term").isin(list(terms)))
    return j.withColumn("same_sign",
                        flag(F.coalesce(F.col(f"{na}_coef"), F.lit(0.0))
                             * F.coalesce(F.col(f"{nb}_coef"), F.lit(0.0)) > 0))
