"""The analysis as one run: feeds -> panel -> series -> models -> result tables.

Each stage is a library call; results are written as Parquet tables under
``out_dir`` (the panel partitioned by year). Stages can be chosen; later
stages read the modelling sets through a checkpoint, not by recomputing the
panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import config as K
from furrow.config import AnalysisConfig
from furrow.operators import backtest as B
from furrow.operators import evaluate as E
from furrow.operators import impute as I
from furrow.operators import market, panel
from furrow.operators import profile as PR
from furrow.operators import specs as S
from furrow.operators import trees as TR
from furrow.session import materialize
from furrow.sources.feeds import write_table

STAGES = ("panel", "series", "profile", "baseline", "compare", "diagnostics", "district", "volume",
          "variety", "impute")
FAST_STAGES = tuple(s for s in STAGES if s != "impute")


def _save(df: DataFrame, out_dir: str, name: str, partition_by: Sequence[str] = ()) -> str:
    path = f"{out_dir}/{name}"
    write_table(df, path, partition_by=partition_by)
    return path


def run(spark: SparkSession, feeds: dict[str, DataFrame], cfg: AnalysisConfig, out_dir: str,
        stages: Sequence[str] = FAST_STAGES, trees: bool = False) -> dict[str, str]:
    """Run the chosen stages; return {table name: path}. ``trees=True`` adds
    the boosted-tree and forest models to the comparison grid."""
    out: dict[str, str] = {}
    stages = set(stages)
    p = materialize(panel.weekly_panel(feeds, cfg))
    if "panel" in stages:
        out["weekly_panel"] = _save(p, out_dir, "weekly_panel", ("year",))
    main = materialize(B.add_targets(market.market_series(p, cfg)))
    dist = materialize(S.district_design(market.district_series(p, cfg), cfg))
    if "series" in stages:
        out["market_series"] = _save(main, out_dir, "market_series")
        out["district_series"] = _save(dist, out_dir, "district_series")
    key = [(cfg.main_series,)]
    if "profile" in stages:
        by = ["series"]
        for name, table in (
                ("coverage_by_district", PR.coverage_by_district(p)),
                ("coverage_by_type", PR.coverage_by_type(p, cfg)),
                ("summary_statistics", PR.summary_statistics(main, by, ["price", "volume", "coverage"])),
                ("event_shares", PR.event_shares(main, by, ["extreme_heat", "freeze_risk", "heavy_rain"])),
                ("seasonal_profile", PR.seasonal_profile(main, by)),
                ("price_share", PR.price_share(dist, by)),
                ("volatile_years", E.volatile_years(main, by)),
                ("extreme_year_profile", E.year_price_profile(main, by, cfg.extreme_year)),
                ("shipment_profile", PR.feed_profile(feeds["shipments"], "week_ending", ["district", "commodity"])),
                ("price_profile", PR.feed_profile(feeds["prices"], "report_date", ["district", "commodity"])),
                ("price_rows_by_year", PR.rows_by_year(feeds["prices"], "report_date")),
                ("weather_missing_days", PR.missing_days(feeds["weather"], "location", "date")),
                ("early_late_change", PR.early_late_change(panel.mostly_midpoints(feeds["prices"], cfg), cfg.price_early_last,
                                                           cfg.price_late_first))):
            out[name] = _save(table, out_dir, name)
    if "baseline" in stages:
        c, f = S.fit_specs(spark, S.with_log_price(main), S.baseline_specs(), ["series"], key)
        out["insample_coefficients"] = _save(c, out_dir, "insample_coefficients")
        out["insample_fit"] = _save(f, out_dir, "insample_fit")
    usable = B.complete_cases(main, B.PRICE_MODELS, extra=["price_lag1", "dprice", "log_dprice"])
    cols = ["series", "model", "year", "week_ending", "coverage", "pred_level", "actual"]
    if "compare" in stages:
        preds = B.ols_backtest(usable, B.PRICE_MODELS, min_train=cfg.min_train_years).select(cols)
        if trees:
            preds = preds.unionByName(TR.tree_backtest(
                spark, usable, B.PRICE_MODELS, min_train=cfg.min_train_years).select(cols))
        preds = preds.unionByName(B.naive_predictions(usable, min_train=cfg.min_train_years).select(cols))
        scores = B.score(preds, ["series", "model"])
        out["fold_scores"] = _save(scores, out_dir, "fold_scores")
        out["leaderboard"] = _save(B.leaderboard(scores, ["series", "model"],
                                                 "Naive (price=lag1)"), out_dir, "leaderboard")
        if trees:
            ols, boosted = B.PRICE_MODELS[0], B.PRICE_MODELS[2]
            out["ols_vs_boosted"] = _save(E.improvement(scores, ["series"], ols.name, boosted.name), out_dir, "ols_vs_boosted")
            out["importances"] = _save(TR.importances(spark, usable, boosted, {"series": cfg.main_series}), out_dir, "importances")
        # Extreme weather as indicators, as degree days, as both.
        rows = B.complete_cases(main, B.EXTREME_SPECS + B.PRICE_MODELS, extra=["price_lag1", "dprice"])
        naive = B.naive_predictions(rows, min_train=cfg.min_train_years).select(cols)
        extreme = B.ols_backtest(rows, B.EXTREME_SPECS, min_train=cfg.min_train_years).select(cols).unionByName(naive)
        out["extreme_weather_specs"] = _save(B.leaderboard(B.score(extreme, ["series", "model"]), ["series", "model"],
                                                           "Naive (price=lag1)"), out_dir, "extreme_weather_specs")
    if "diagnostics" in stages:
        full = B.PRICE_MODELS[0]
        keys = ["series", "model"]
        expanding = materialize(B.ols_backtest(usable, [full], min_train=cfg.min_train_years))
        table = E.prediction_table(expanding, keys)
        out["predictions"] = _save(table, out_dir, "predictions")
        out["error_by_coverage"] = _save(E.error_by_coverage(table, keys), out_dir, "error_by_coverage")
        out["error_by_coverage3"] = _save(E.error_by_coverage(table, keys, K.COVERAGE_BINS_3), out_dir, "error_by_coverage3")
        out["period_coefficients"] = _save(B.period_coefficients(usable, full.features, full.target, cfg.periods), out_dir,
                                           "period_coefficients")
        out["period_errors"] = _save(E.period_errors(table, keys, cfg.early_last_year), out_dir,
                                     "period_errors")
        out["partial_year"] = _save(E.partial_year_sensitivity(table, keys, cfg.partial_year),
                                    out_dir, "partial_year")
        out["extreme_year"] = _save(E.extreme_year_split(table, keys, cfg.extreme_year), out_dir, "extreme_year")
        exp_s = B.score(expanding, keys)
        roll_s = B.score(B.ols_backtest(usable, [full], mode="rolling", window_years=cfg.rolling_years,
                                        min_train=cfg.min_train_years, min_train_rows=cfg.rolling_min_train), keys)
        out["expanding_vs_rolling"] = _save(E.compare_folds(exp_s, roll_s, keys), out_dir,
                                            "expanding_vs_rolling")
    if "district" in stages:
        c, f = S.fit_specs(spark, dist, S.district_specs(), ["series"], key, cov="cluster",
                           cluster="district")
        out["district_coefficients"] = _save(c, out_dir, "district_coefficients")
        out["district_fit"] = _save(f, out_dir, "district_fit")
        out["transition_split"] = _save(PR.transition_split(dist, ["series"]), out_dir, "transition_split")
    if "volume" in stages:
        c, f = S.fit_specs(spark, main, S.volume_specs(), ["series"], key)
        out["volume_coefficients"] = _save(c, out_dir, "volume_coefficients")
        u = B.complete_cases(main, B.VOLUME_MODELS, extra=["dvolume", "volume_lag1"])
        out["volume_fit"] = _save(f, out_dir, "volume_fit")
        vp = B.ols_backtest(u, B.VOLUME_MODELS, min_train=cfg.min_train_years).select(cols).unionByName(
            B.naive_predictions(u, target="volume", name="Naive (vol=lag1)", min_train=cfg.min_train_years).select(cols))
        if trees:
            vp = vp.unionByName(TR.tree_backtest(spark, u, B.VOLUME_MODELS, min_train=cfg.min_train_years).select(cols))
        out["volume_leaderboard"] = _save(B.leaderboard(B.score(vp, ["series", "model"]),
                                                        ["series", "model"], "Naive (vol=lag1)"),
                                          out_dir, "volume_leaderboard")
    if "variety" in stages:
        second = market.market_series(p, cfg, [cfg.second_series], round_all=False)
        both = materialize(B.add_targets(main.drop("dprice", "log_dprice", "dvolume")
                                         .unionByName(second)))
        c, f = S.fit_specs(spark, both, S.variety_specs(), ["series"],
                           [(cfg.main_series,), (cfg.second_series,)])
        out["variety_fit"] = _save(f, out_dir, "variety_fit")
        a = c.where(F.col("series") == cfg.main_series)
        b = c.where(F.col("series") == cfg.second_series)
        out["variety_signs"] = _save(S.compare_coefficients(a, b, ["spec"]), out_dir, "variety_signs")
    if "impute" in stages:
        frame = materialize(I.imputation_frame(p, cfg))
        out["impute_backtest"] = _save(I.imputation_backtest(spark, frame, cfg), out_dir,
                                       "impute_backtest")
        imputed = materialize(I.impute_missing(spark, frame, cfg))
        out["imputed_prices"] = _save(imputed, out_dir, "imputed_prices")
        out["imputed_by_district"] = _save(I.compare_by_district(imputed, frame), out_dir, "imputed_by_district")
    return out
