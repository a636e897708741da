"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c: ColumnOrName) -> Column:
    """Text with thousands commas -> double; bad text and NaN -> NULL."""
    num = F.trim(F.translate(_c(c).cast("string"), ",", "")).try_cast("double")
    return F.when(F.isnan(num), F.lit(None).cast("double")).otherwise(num)


MIXED_DATE_FORMATS = (
    "M/d/yyyy",
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "M/d/yy",
    "yyyy/M/d",
    "MMM d, yyyy",
    "d-MMM-yyyy",
)


def parse_date_mixed(c: ColumnOrName, formats: Iterable[str] = MIXED_DATE_FORMATS) -> Column:
    """First format that parses wins; NULL when none does."""
    txt = F.trim(_c(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(txt, F.lit(f)) for f in formats]).cast("date")


def parse_date_us(c: ColumnOrName) -> Column:
    """MM/DD/YYYY (one- or two-digit month and day) -> date, else NULL."""
    txt = F.trim(_c(c).cast("string"))
    return F.try_to_timestamp(txt, F.lit("M/d/yyyy")).cast("date")


def title_case(c: ColumnOrName) -> Column:
    """Every run of letters with a capital first and small letters after it, whatever
    stands between the runs (blanks, hyphens, apostrophes, slashes, brackets)."""
    runs = F.regexp_extract_all(_c(c), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.initcap(w)), "")


def trimmed_or(c: ColumnOrName, default: str) -> Column:
    """Trim; a missing value becomes the default."""
    return F.coalesce(F.trim(_c(c)), F.lit(default))


def week_ending_tuesday(c: ColumnOrName) -> Column:
    """Date -> the Tuesday that closes its week (a Tuesday maps to itself)."""
    return F.next_day(F.date_sub(F.to_date(_c(c)), 1), "TUE")


def degree_days_above(c: ColumnOrName, base: float) -> Column:
    """max(x - base, 0), missing stays missing."""
    x = _c(c)
    return F.when(x.isNotNull(), F.greatest(x - F.lit(base), F.lit(0.0)))


def degree_days_below(c: ColumnOrName, base: float) -> Column:
    """max(base - x, 0), missing stays missing."""
    x = _c(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(base) - x, F.lit(0.0)))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 where a missing comparison counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def round_half_even(c: ColumnOrName, digits: int) -> Column:
    """NumPy's rounding: scale, round half to even on the binary value, unscale
    (2.175 is stored just below 2.175 and becomes 2.17, unlike ``bround``,
    which rounds the decimal text)."""
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def zero_to_null(c: ColumnOrName) -> Column:
    x = _c(c)
    return F.when(x != 0, x)


def midpoint_with_fallback(mostly_low: ColumnOrName, mostly_high: ColumnOrName,
                           low: ColumnOrName, high: ColumnOrName, text: bool = True) -> Column:
    """Mean of the 'mostly' pair, else mean of low/high; both ends needed.

    ``text=True`` parses raw text prices first (bad text -> missing)."""
    conv = parse_number if text else _c
    ml, mh = conv(mostly_low), conv(mostly_high)
    lo, hi = conv(low), conv(high)
    return F.coalesce((ml + mh) / 2.0, (lo + hi) / 2.0)


def state_label(district: ColumnOrName, az_districts: Iterable[str]) -> Column:
    return F.when(_c(district).isin(list(az_districts)), "AZ").otherwise("CA")


def month_in(month: ColumnOrName, months: Iterable[int]) -> Column:
    return flag(_c(month).isin(list(months)))


def transition_week(week: ColumnOrName, spans) -> Column:
    w = _c(week)
    cond = None
    for lo, hi in spans:
        part = w.between(lo, hi)
        cond = part if cond is None else (cond | part)
    return flag(cond)


def safe_log(c: ColumnOrName) -> Column:
    """Natural log for positive values, NULL otherwise."""
    x = _c(c)
    return F.when(x > 0, F.ln(x))


def stars(p: ColumnOrName, thresholds) -> Column:
    """Significance stars from a p-value."""
    x = _c(p)
    out = F.lit("")
    for limit, mark in reversed(list(thresholds)):
        out = F.when(x < limit, F.lit(mark)).otherwise(out)
    return out


def bin_label(x: ColumnOrName, bins, closed: str = "left") -> Column:
    """Label of the bin holding x: [lo, hi) when closed='left', (lo, hi] else."""
    v = _c(x)
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(bins)):
        cond = (v >= lo) & (v < hi) if closed == "left" else (v > lo) & (v <= hi)
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def bin_order(x: ColumnOrName, bins, closed: str = "left") -> Column:
    v = _c(x)
    out = F.lit(None).cast("int")
    for i, (lo, hi, _label) in reversed(list(enumerate(bins))):
        cond = (v >= lo) & (v < hi) if closed == "left" else (v > lo) & (v <= hi)
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out
