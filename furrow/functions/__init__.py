"""Column expressions, window helpers and skew-safe aggregates."""

from furrow.functions.aggregates import exact_median, literal_table, weighted_mean
from furrow.functions.columns import (
    bin_label, degree_days_above, degree_days_below, flag, midpoint_with_fallback,
    parse_date_mixed, parse_date_us, parse_number, safe_log, stars, state_label, title_case,
    transition_week, trimmed_or, week_ending_tuesday, zero_to_null,
)
from furrow.functions.windows import lag_columns, ordered, rolling_mean, rolling_std, trailing

__all__ = [
    "bin_label", "degree_days_above", "degree_days_below", "exact_median",
    "flag", "lag_columns", "literal_table", "midpoint_with_fallback", "ordered",
    "parse_date_mixed", "parse_date_us", "parse_number", "rolling_mean", "rolling_std",
    "safe_log", "stars", "state_label", "title_case", "trailing", "transition_week",
    "trimmed_or", "week_ending_tuesday", "weighted_mean", "zero_to_null",
]
