"""Null-safe numeric helpers (D1, D2, D9, D10, D18 of the survey)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["col_", "to_double", "nan_to_null", "flag", "flag_sum", "row_mean_skipna",
           "row_mean_strict", "safe_value", "clip_lower", "ratio_by_phase",
           "exact_mean", "tenure"]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN never survives load: Spark orders NaN above every number."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c, decimal_comma: bool = False) -> Column:
    """Coerce text to double; bad text and NaN become NULL.

    Like ``to_numeric(errors='coerce')`` a decimal comma ("7,5") is bad text
    unless ``decimal_comma`` is set."""
    c = F.trim(col_(c).cast("string"))
    if decimal_comma:
        c = F.regexp_replace(c, ",", ".")
    return nan_to_null(c.try_cast("double"))


def flag(cond: Column) -> Column:
    """Threshold flag with NULL → 0 (P11, D1): pandas compares NaN as False."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def flag_sum(flags: Iterable[Column]) -> Column:
    """Sum of 0/1 flags."""
    flags = list(flags)
    return reduce(lambda a, b: a + b, flags) if flags else F.lit(0)


def row_mean_skipna(cols: Iterable) -> Column:
    """Mean over the non-null inputs; NULL when all are NULL."""
    cols = [col_(c).cast("double") for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def row_mean_strict(cols: Iterable) -> Column:
    """(a+b+...)/k, NULL if any input is NULL."""
    cols = [col_(c).cast("double") for c in cols]
    return reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols)))


def safe_value(c, default: float) -> Column:
    """Numeric value or a default when missing/unparsable."""
    return F.coalesce(nan_to_null(col_(c).cast("string").try_cast("double")), F.lit(float(default)))


def clip_lower(c, lower=0) -> Column:
    """``clip(lower=...)`` keeping NULL as NULL."""
    c = col_(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lower)))


def ratio_by_phase(a, phase) -> Column:
    """a / (phase + 1)."""
    return F.try_divide(col_(a).cast("double"), (col_(phase) + F.lit(1)).cast("double"))


def exact_mean(c, scale: int = 4) -> Column:
    """Aggregate mean of a column that holds values with at most ``scale``
    decimals, summed exactly as scaled longs: identical on every partitioning
    and in any engine (cheap long adds, no decimal objects). Values with more
    decimals would be rounded to ``scale`` first: pass no scale for them
    (``aggregates.mean_of`` then takes a plain average)."""
    m = 10 ** scale
    s = F.sum(F.round(col_(c) * F.lit(float(m))).cast("long"))
    return F.try_divide(s.cast("double") / F.lit(float(m)), F.count(col_(c)).cast("double"))


def tenure(entry_year, reference_year: int, clip_at_zero: bool = False) -> Column:
    """Reference year − entry year; optionally clipped at 0 (NULL
    stays NULL)."""
    t = F.lit(int(reference_year)) - col_(entry_year)
    return clip_lower(t, 0) if clip_at_zero else t
