"""CASE-WHEN builders for bands, levels and verdicts.

All of them are plain column expressions, so they run inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelkit import config as C
from panelkit.functions.core import col_

__all__ = ["band_ge", "band_lt", "band_le", "ian_band", "tier_of", "tier_ordinal",
           "monitor_level", "individual_level", "attention_level", "attrition_band",
           "lag_band", "trend_verdict", "inde_message", "colour_band", "map_lookup",
           "next_tier", "null_share_status"]


def _chain(conds: Sequence[tuple[Column, str]], otherwise, missing: Column | None = None,
           missing_label=None) -> Column:
    expr = None
    if missing is not None:
        expr = F.when(missing, F.lit(missing_label))
    for cond, label in conds:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise)) if otherwise is not None else expr


def band_ge(c, bands: Sequence[tuple[float, str]], lowest, missing_label=None) -> Column:
    """First band whose lower bound ``c >= t`` holds, scanning bands in order."""
    c = col_(c)
    return _chain([(c >= F.lit(t), lab) for t, lab in bands], lowest,
                  c.isNull() if missing_label is not None else None, missing_label)


def band_lt(c, bands: Sequence[tuple[float, str]], top, missing_label=None) -> Column:
    """First band with ``c < t`` (ascending cut points)."""
    c = col_(c)
    return _chain([(c < F.lit(t), lab) for t, lab in bands], top,
                  c.isNull() if missing_label is not None else None, missing_label)


def band_le(c, bands: Sequence[tuple[float, str]], top, missing_label=None) -> Column:
    c = col_(c)
    return _chain([(c <= F.lit(t), lab) for t, lab in bands], top,
                  c.isNull() if missing_label is not None else None, missing_label)


def ian_band(c="ian") -> Column:
    """Level-adequacy band (F1)."""
    return band_ge(c, C.IAN_BANDS, C.IAN_LOWEST, C.IAN_MISSING)


def tier_of(c="inde", cuts=None, top=None, missing=C.TIER_MISSING) -> Column:
    """Tier from index cut points (F2); ``cuts`` defaults to the domain ones."""
    return band_lt(c, cuts or C.TIER_CUTS, top or C.TIER_TOP, missing)


def map_lookup(c, mapping: dict, fallback_to_input: bool = False) -> Column:
    """Dictionary lookup as a map literal (J2, X6); the map is part of the plan,
    so it costs no join and no shuffle."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    v = m[col_(c)]
    return F.coalesce(v, col_(c)) if fallback_to_input else v


def tier_ordinal(c="tier") -> Column:
    """Ordinal of a tier; accepts accented and unaccented spellings."""
    m = dict(C.TIER_ORDINAL)
    for bad, good in C.TIER_SPELLING.items():
        m[bad] = C.TIER_ORDINAL[good]
    return map_lookup(c, m)


def next_tier(c="tier") -> Column:
    """Next tier."""
    return map_lookup(c, C.TIER_NEXT)


def monitor_level(n) -> Column:
    """Signal count → monitoring level."""
    n = col_(n)
    return band_ge(n, C.MONITOR_LEVELS, C.MONITOR_NONE)


def individual_level(n) -> Column:
    return band_ge(col_(n), C.INDIVIDUAL_LEVELS, C.INDIVIDUAL_LOW)


def attention_level(n) -> Column:
    return band_ge(col_(n), C.ATTENTION_LEVELS, C.ATTENTION_LOW)


def attrition_band(p) -> Column:
    """<0.30 stable; 0.30–0.60 inclusive follow-up; >0.60 attention."""
    p = col_(p)
    return (F.when(p < F.lit(0.30), F.lit(C.ATTRITION_BANDS[0][1]))
            .when(p <= F.lit(0.60), F.lit(C.ATTRITION_BANDS[1][1]))
            .when(p.isNotNull(), F.lit(C.ATTRITION_TOP)))


def lag_band(p) -> Column:
    return F.when(col_(p).isNotNull(), band_le(p, C.LAG_BANDS, C.LAG_TOP))


def trend_verdict(delta) -> Column:
    """last − first > eps up; < −eps down; else flat."""
    d = col_(delta)
    return (F.when(d > F.lit(C.TREND_EPS), F.lit("up"))
            .when(d < F.lit(-C.TREND_EPS), F.lit("down"))
            .when(d.isNotNull(), F.lit("flat")))


def inde_message(c) -> Column:
    """Message band of the index; missing is read as 5.0."""
    v = F.coalesce(col_(c), F.lit(C.INDE_MESSAGE_MISSING_AS))
    return band_le(v, C.INDE_MESSAGES, C.INDE_MESSAGE_TOP)


def colour_band(c) -> Column:
    """≥7 high / ≥5 mid / else (missing = low)."""
    return band_ge(col_(c), [(7.0, "high"), (5.0, "mid")], "low")


def status_text(c) -> Column:
    """≥8 excellent / ≥6 good / else in development (F18); missing stays missing."""
    return F.when(col_(c).isNotNull(), band_ge(col_(c), C.STATUS_BANDS, C.STATUS_LOW))


def null_share_status(pct) -> Column:
    return band_lt(pct, [(C.NULL_SHARE_OK, "ok"), (C.NULL_SHARE_WARN, "warn")], "bad")
