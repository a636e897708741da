"""Window helpers: row lags and rolling statistics with a minimum count.

All windows are partitioned by the series keys, so no window runs over an
unpartitioned frame. Rolling frames count rows, not calendar weeks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(keys: Sequence[str], order: str, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` rows before it."""
    return ordered(keys, order).rowsBetween(-(rows - 1), Window.currentRow)


def rolling_mean(col: str, w: WindowSpec, min_count: int) -> Column:
    """Mean over the frame, NULL when fewer than ``min_count`` values."""
    return F.when(F.count(col).over(w) >= min_count, F.avg(col).over(w))


def rolling_std(col: str, w: WindowSpec, min_count: int) -> Column:
    """Sample standard deviation (ddof=1) with a minimum count."""
    return F.when(F.count(col).over(w) >= min_count, F.stddev_samp(col).over(w))


def lag_columns(cols: Sequence[str], lags: Sequence[int], w: WindowSpec,
                names: dict[str, str] | None = None) -> list[Column]:
    """``<name>_lag<k>`` for every column and lag."""
    names = names or {}
    out = []
    for k in lags:
        for c in cols:
            out.append(F.lag(c, k).over(w).alias(f"{names.get(c, c)}_lag{k}"))
    return out
