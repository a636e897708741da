"""Keyed deduplication (D1 keep-last, D2 keep-first).

Both are a single hash aggregate: ``max_by`` / ``min_by`` of the whole row
under an ordering struct. The aggregate is partial (map-side), so a hot key
is reduced to one row per input partition before the shuffle — no sort of
a hot key's rows in one task, unlike a ``row_number`` window. The ordering
must be total (end it with a row sequence or all remaining columns) to make
the survivor deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: Sequence[str], order: Sequence[Column], last: bool) -> DataFrame:
    cols = df.columns
    ordkey = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    row = F.struct(*[F.col(c) for c in cols])
    agg = F.max_by(row, ordkey) if last else F.min_by(row, ordkey)
    return df.groupBy(*key).agg(agg.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in cols])


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per key, the row that sorts last by ``order`` (ascending semantics)."""
    return _pick(df, key, order, last=True)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per key, the row that sorts first by ``order``."""
    return _pick(df, key, order, last=False)


def nulls_last(c: str) -> list[Column]:
    """Ascending sort with missing values after all others (pandas default)."""
    return [F.col(c).isNull(), F.col(c)]


def shipment_order(extra: Sequence[str] = ()) -> list[Column]:
    """Week, region (missing last), district, commodity, then source rank
    and row sequence (a stable sort keeps file order among equals)."""
    out = [F.col("week_ending"), *nulls_last("region"), F.col("district"), F.col("commodity"),
           F.col("source_rank"), F.col("row_seq")]
    return out + [F.col(c) for c in extra]


def price_order(extra: Sequence[str] = ()) -> list[Column]:
    """File precedence then position in the file."""
    return [F.col("file_rank"), F.col("row_seq")] + [F.col(c) for c in extra]
