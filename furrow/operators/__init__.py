"""Pipeline operators: dedup, panel, series, folds, models, diagnostics, profiles."""
