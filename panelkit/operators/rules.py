"""Rule scoring (R1–R5, F10–F12): flags, counts, levels and reasons as one
projection — no per-row Python."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit import config as C
from panelkit.functions.bands import attention_level, individual_level, monitor_level
from panelkit.functions.core import flag, flag_sum

__all__ = ["reasons", "monitor_table", "alert_levels", "level_distribution", "signal_count_distribution",
           "watch_list", "attention_scores", "recommendations", "SIGNALS"]

SIGNALS = ["s1_engagement", "s2_psychosocial", "s3_tier_drop", "s4_performance", "s5_stagnation"]


def reasons(conds: Sequence[Column], texts: Sequence[str], default: str | None = None) -> Column:
    """array of the texts whose condition holds, in rule order; with
    ``default`` an empty list becomes ``[default]``."""
    arr = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in zip(conds, texts)]))
    if default is None:
        return arr
    return F.when(F.size(arr) == 0, F.array(F.lit(default))).otherwise(arr)


def _val(c: str, missing_as: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)) if missing_as == "zero" else F.col(c)


def _signal_conds(ieg="ieg", ips="ips", ida="ida", tier_change="tier_change", tenure="tenure",
                  missing_as="no_signal", ieg_lt=C.ALERT_IEG_LT, ips_lt=C.ALERT_IPS_LT,
                  ida_lt=C.ALERT_IDA_LT, years_gt=C.ALERT_YEARS_GT):
    ch = F.coalesce(F.col(tier_change), F.lit(0))
    return [
        _val(ieg, missing_as) < F.lit(ieg_lt),
        _val(ips, missing_as) < F.lit(ips_lt),
        ch < 0,
        _val(ida, missing_as) < F.lit(ida_lt),
        (F.col(tenure) > F.lit(years_gt)) & (ch <= 0),
    ]


def monitor_table(df: DataFrame, keep: Sequence[str] = (), missing_as: str = "no_signal", **thr) -> DataFrame:
    """Five 0/1 signals, their count, alert flag (≥2) and level.
    ``missing_as='zero'`` reads a missing indicator as 0 (D20)."""
    conds = _signal_conds(missing_as=missing_as, **thr)
    flags = {s: flag(c) for s, c in zip(SIGNALS, conds)}
    out = df.select(*keep, *[v.alias(k) for k, v in flags.items()])
    n = flag_sum([F.col(s) for s in SIGNALS])
    return (out.withColumn("n_signals", n)
            .withColumn("in_alert", (F.col("n_signals") >= C.ALERT_FLAG_AT).cast("int"))
            .withColumn("level", monitor_level("n_signals")))


def alert_levels(df: DataFrame, keep: Sequence[str] = (), missing_as: str = "no_signal", **thr) -> DataFrame:
    """R2: individual alert level, signal count and reason list per entity."""
    s1, s2, s3, s4, s5 = _signal_conds(missing_as=missing_as, **thr)
    n = flag_sum([flag(c) for c in (s1, s2, s3, s4, s5)])
    # reasons are listed engagement, psychosocial, performance, tier drop, stagnation
    return df.select(*keep, n.alias("n_signals"), individual_level(n).alias("level"),
                     reasons([s1, s2, s4, s3, s5], C.ALERT_REASONS).alias("reasons"))


def level_distribution(mon: DataFrame) -> DataFrame:
    """Rows per level, largest first."""
    return mon.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level")


def signal_count_distribution(mon: DataFrame) -> DataFrame:
    """Rows per signal count, in count order."""
    return mon.groupBy("n_signals").agg(F.count(F.lit(1)).alias("n")).orderBy("n_signals")


def watch_list(mon: DataFrame, cols: Sequence[str], order_tiebreak: str) -> DataFrame:
    """Entities in alert, chosen columns, most signals first."""
    return (mon.filter(F.col("in_alert") == 1).select(*cols, "n_signals", "level")
            .orderBy(F.desc("n_signals"), F.asc(order_tiebreak)))


def attention_scores(df: DataFrame, keep: Sequence[str] = (), lag: str | None = "lag",
                     rules=None) -> DataFrame:
    """Attention score = flags ieg<5.5, ips<5.0, ida<5.5, inde<5.0 and
    lag<0 (NULL → no flag), with level."""
    rules = rules or C.ATTENTION_RULES
    flags = [flag(F.col(c) < F.lit(t)) for c, t in rules if c in df.columns]
    if lag and lag in df.columns:
        flags.append(flag(F.col(lag) < 0))
    s = flag_sum(flags)
    return df.select(*keep, s.alias("score"), attention_level(s).alias("level"))


def recommendations(ieg="ieg", ips="ips", ida="ida", iaa="iaa", missing_as: str = "zero") -> Column:
    """recommendation texts for one profile row (default when none). The
    profile reads a missing indicator as 0, as its alerts do (D20)."""
    ieg, ips, ida, iaa = (_val(c, missing_as) for c in (ieg, ips, ida, iaa))
    conds = [ieg < F.lit(C.ALERT_IEG_LT), ips < F.lit(C.ALERT_IPS_LT),
             ida < F.lit(C.ALERT_IDA_LT), (iaa - ida) > F.lit(C.RECOMMEND_GAP)]
    return reasons(conds, C.RECOMMENDATIONS, C.RECOMMEND_DEFAULT)
