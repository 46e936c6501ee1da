"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelkit import config as C
from panelkit.functions.core import col_

__all__ = ["replace_tokens", "null_tokens", "canonical_tier", "leading_int", 
           "upper_key", "name_matches", "first_word", "short_label"]


def replace_tokens(c, mapping: dict) -> Column:
    """Whole-value token replacement (``Series.replace``) as a CASE chain."""
    c = col_(c)
    expr = None
    for k, v in mapping.items():
        val = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(c == F.lit(k), val) if expr is None else expr.when(c == F.lit(k), val)
    return c if expr is None else expr.otherwise(c)


def null_tokens(c, tokens=None) -> Column:
    """Known junk tokens and blanks become NULL."""
    c = col_(c)
    tokens = tokens if tokens is not None else C.NULL_TOKENS
    return F.when(F.trim(c).isin(*tokens) | (F.trim(c) == F.lit("")), F.lit(None).cast("string")).otherwise(c)


def canonical_tier(c) -> Column:
    """One accented spelling for every tier variant."""
    return replace_tokens(null_tokens(c), C.TIER_SPELLING)


def leading_int(c) -> Column:
    """First run of digits anywhere in the text → int, else NULL."""
    s = F.regexp_extract(col_(c).cast("string"), r"(\d+)", 1)
    return F.nullif(s, F.lit("")).try_cast("int")


def upper_key(c) -> Column:
    """Upper-cased, trimmed name key; NULL stays NULL."""
    return F.upper(F.trim(col_(c).cast("string")))


def name_matches(c, pattern: str, literal: bool = True) -> Column:
    """Case-insensitive search; NULL never matches."""
    c = F.upper(col_(c))
    cond = c.contains(pattern.upper()) if literal else c.rlike(pattern)
    return F.coalesce(cond, F.lit(False))


def first_word(c) -> Column:
    return F.split(F.trim(col_(c)), " ").getItem(0)


def short_label(c, n: int = 20) -> Column:
    return F.substring(col_(c).cast("string"), 1, n)
