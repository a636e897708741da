"""Declared output schemas shared by the Spark queries and their SQL oracles.

Each registered query lists its output columns with a kind: ``int`` (BIGINT),
``dbl`` (DOUBLE), ``str`` or ``date``. The same list drives the final Spark
projection and the DuckDB wrapper, so column names, types and rounding agree on
both sides. Doubles are rounded only where an oracle compares them: to ``DIGITS``
places, below 1 to ``SMALL_DIGITS`` places. Queries without SQL return them whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, SMALL_DIGITS = 4, 9
SCALE, SMALL_SCALE = 10.0 ** DIGITS, 10.0 ** SMALL_DIGITS
# Quantisation threshold. Test data often carries exactly DIGITS+1 decimals
# ending in 5 (a rounding tie) and two engines sum in different orders, so a
# plain round() can land on different sides of the tie. Both sides instead
# compute floor(x * SCALE + OFFSET) / SCALE with the same IEEE operations;
# an off-centre OFFSET keeps short decimals away from the bucket edge.
OFFSET = 0.499682
# floor() yields a 64-bit integer in Spark: quantise only where x * SCALE fits
# with room to spare; larger magnitudes pass through unchanged.
QUANT_LIMIT = 1e14

Cols = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: Cols
    sql: str | None = None
    doc: str = ""


def finish(df: DataFrame, columns: Cols, compared: bool = True) -> DataFrame:
    """Project to the declared columns with the declared kinds; doubles are
    rounded where an oracle is compared."""
    out = []
    for name, kind in columns:
        c = F.col(name)
        if kind == "int":
            out.append(c.cast("bigint").alias(name))
        elif kind == "dbl":
            x = c.cast("double")
            cut = [(F.floor(x * F.lit(k) + F.lit(OFFSET)) / F.lit(k)).cast("double") for k in (SMALL_SCALE, SCALE)]
            q = F.when(F.abs(x) < 1.0, cut[0]).when(F.abs(x) < F.lit(QUANT_LIMIT), cut[1]).otherwise(x)
            out.append(F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(q if compared else x).alias(name))
        elif kind == "str":
            out.append(c.cast("string").alias(name))
        elif kind == "date":
            out.append(F.to_date(c).alias(name))
        elif kind == "raw":
            out.append(c.alias(name))
        else:
            raise ValueError(kind)
    return df.select(*out)


def wrap_sql(inner: str, columns: Cols) -> str:
    """Wrap an oracle query so its output matches ``finish``."""
    parts = []
    for name, kind in columns:
        q = f'"{name}"'
        if kind == "int":
            parts.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "dbl":
            x = f"CAST({q} AS DOUBLE)"
            parts.append(f"CASE WHEN abs({x}) < 1.0::DOUBLE THEN CAST(floor({x} * {SMALL_SCALE!r}::DOUBLE + {OFFSET!r}::DOUBLE)"
                         f" / {SMALL_SCALE!r}::DOUBLE AS DOUBLE) WHEN abs({x}) < {QUANT_LIMIT!r}::DOUBLE THEN "
                         f"CAST(floor({x} * {SCALE!r}::DOUBLE + {OFFSET!r}::DOUBLE)"
                         f" / {SCALE!r}::DOUBLE AS DOUBLE) ELSE {x} END AS {q}")
        elif kind == "str":
            parts.append(f"CAST({q} AS VARCHAR) AS {q}")
        elif kind == "date":
            parts.append(f"CAST({q} AS DATE) AS {q}")
        else:
            parts.append(q)
    return "SELECT " + ", ".join(parts) + " FROM (\n" + inner + "\n) AS q"


def kinds(spec: str) -> list[tuple[str, str]]:
    """Compact declaration: 'a:int b:dbl c' (default kind dbl)."""
    out = []
    for tok in spec.split():
        name, _, kind = tok.partition(":")
        out.append((name, kind or "dbl"))
    return out
