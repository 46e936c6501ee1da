"""Report builders (R6–R18): compositions of the operators, each returning
small result tables; no figure code."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit import config as C
from panelkit.functions.bands import ian_band
from panelkit.operators import aggregates as A
from panelkit.operators import stats as S
from panelkit.operators import windows as W

__all__ = ["adequacy_evolution", "performance_evolution", "engagement", "self_assessment", "gap_histogram", "psychosocial",
           "psychosocial_bins", "assessment_vs_adequacy", "assessment_verdict", "turning_point_drivers",
           "turning_point_profile", "multidimensional", "trajectory", "effectiveness", "segments", "overview", "profile_360"]


def adequacy_evolution(p: DataFrame, year="yr", ian="ian", scale=None) -> dict[str, DataFrame]:
    """Band share per year + mean/median/std trend."""
    return {"share": A.group_share(p.withColumn("band", ian_band(ian)), year, "band"),
            "trend": A.year_stats(p, year, ian, scale)}


def performance_evolution(p: DataFrame, year="yr", ida="ida", tier="tier", scale=None) -> dict[str, DataFrame]:
    """Yearly stats, year × tier means, and the trend verdict."""
    ys = A.year_stats(p, year, ida, scale)
    return {"by_year": ys, "by_year_tier": A.group_means(p, [year, tier], [ida], scale),
            "trend": W.series_change(ys, year, "mean")}


def engagement(p: DataFrame, ieg="ieg", ida="ida", ipv="ipv") -> DataFrame:
    """Two regressions and two correlations on complete rows."""
    d = p.dropna(subset=[ieg, ida, ipv])
    return d.agg(F.round(F.corr(ieg, ida), 6).alias("r_ieg_ida"), F.round(F.corr(ieg, ipv), 6).alias("r_ieg_ipv"),
                 F.round(F.regr_slope(ida, ieg), 6).alias("slope_ida"), F.round(F.regr_slope(ipv, ieg), 6).alias("slope_ipv"))


def self_assessment(p: DataFrame, iaa="iaa", ida="ida", ieg="ieg", scale=None) -> DataFrame:
    """On rows complete in self-assessment, performance and engagement:
    mean gap, line of performance on self-assessment, correlation, verdict
    (gap > 0.5 over; |gap| < 0.5 coherent; else under)."""
    d = p.dropna(subset=[iaa, ida, ieg])
    gap = A.mean_gap(iaa, ida, scale)
    one = d.agg(gap.alias("mean_gap"), F.round(F.regr_slope(ida, iaa), 6).alias("slope"),
                F.round(F.regr_intercept(ida, iaa), 6).alias("intercept"),
                F.round(F.regr_r2(ida, iaa), 6).alias("r2"), F.round(F.corr(iaa, ida), 6).alias("r"))
    g = F.col("mean_gap")
    return one.withColumn("verdict", F.when(g > C.SELF_ASSESS_GAP, F.lit("over"))
                          .when(F.abs(g) < C.SELF_ASSESS_GAP, F.lit("coherent")).otherwise(F.lit("under")))


def gap_histogram(p: DataFrame, iaa="iaa", ida="ida", ieg="ieg", year="yr", bins: int = 30) -> DataFrame:
    """Histogram of self-assessment minus performance, coloured by year."""
    d = p.dropna(subset=[iaa, ida, ieg]).withColumn("gap", F.round(F.col(iaa) - F.col(ida), 4))
    return S.histogram(d, "gap", bins, year)


def psychosocial(p: DataFrame, ips="ips", ida="ida", ieg="ieg") -> DataFrame:
    """On rows complete in the three: correlations and lines of
    performance and of engagement on psychosocial support."""
    d = p.dropna(subset=[ips, ida, ieg])
    return d.agg(F.round(F.corr(ips, ida), 6).alias("r_ips_ida"), F.round(F.corr(ips, ieg), 6).alias("r_ips_ieg"),
                 F.round(F.regr_slope(ida, ips), 6).alias("slope"), F.round(F.regr_intercept(ida, ips), 6).alias("intercept"),
                 F.round(F.regr_slope(ieg, ips), 6).alias("slope_ieg"),
                 F.round(F.regr_intercept(ieg, ips), 6).alias("intercept_ieg"),
                 (F.corr(ips, ida) > F.lit(0.2)).alias("relevant"))


def psychosocial_bins(p: DataFrame, ips="ips", ida="ida", ieg="ieg", index="inde", scale=None) -> DataFrame:
    """Means of performance, engagement and index per support bin."""
    return S.binned_means(p.dropna(subset=[ips, ida, ieg]), ips, [0, 4, 6, 8, 10], [ida, ieg, index], scale=scale)


def assessment_vs_adequacy(p: DataFrame, ipp="ipp", ian="ian", scale=None) -> DataFrame:
    """On rows complete in both: mean and spread of the assessment index
    per adequacy band."""
    d = p.dropna(subset=[ipp, ian]).withColumn("band", ian_band(ian))
    return A.mean_std(d, ["band"], ipp, scale)


def assessment_verdict(p: DataFrame, ipp="ipp", ian="ian") -> DataFrame:
    """Correlation of assessment and adequacy, line, and whether the one
    confirms the other (r > 0.2)."""
    d = p.dropna(subset=[ipp, ian])
    r = F.corr(ipp, ian)
    return d.agg(F.round(r, 6).alias("r"), F.round(F.regr_slope(ian, ipp), 6).alias("slope"),
                 F.round(F.regr_intercept(ian, ipp), 6).alias("intercept"),
                 F.when(r > 0.2, F.lit("confirms")).otherwise(F.lit("independent")).alias("verdict"))


#: indicators compared with the turning-point index, and the rows that count
DRIVERS = ["ida", "ieg", "iaa", "ips", "ipp", "ian"]
DRIVER_COMPLETE = ["ipv", "ida", "ieg", "iaa", "ips", "ipp"]


def turning_point_drivers(p: DataFrame, target: str = "ipv") -> DataFrame:
    """Correlation with the turning-point index on rows complete in the
    six (D16), ranked by |r|."""
    return S.rank_by_abs(S.corr_target(p.dropna(subset=DRIVER_COMPLETE), target, DRIVERS))


def turning_point_profile(p: DataFrame, flag_col: str = "pv", scale=None) -> DataFrame:
    """Indicator means of rows that reached the turning point and those
    that did not, on the same complete rows."""
    from panelkit.operators.reshape import transpose_means
    return transpose_means(p.dropna(subset=DRIVER_COMPLETE), flag_col, DRIVERS, ["Sim", "Não"], scale=scale)


MULTI = ["ida", "ieg", "ips", "ipp", "iaa", "ipv", "ian"]


def multidimensional(p: DataFrame, index: str = "inde", tier: str = "tier", scale=None) -> dict:
    """Correlation matrix, index drivers and tier profile over seven
    indicators, all on rows complete in these and the index."""
    from panelkit.operators.joins import reindex_groups
    d = p.dropna(subset=[*MULTI, index])
    return {"matrix": S.corr_matrix(d, [*MULTI, index]), "drivers": S.rank_by_abs(S.corr_target(d, index, MULTI)),
            "profile": reindex_groups(A.group_means(d, [tier], MULTI, scale), tier, C.TIER_ORDER)}


def trajectory(p: DataFrame, year="yr", tier="tier", cols=("inde", "ida", "ieg"), scale=None) -> DataFrame:
    """Yearly means and rows per tier, from one aggregation."""
    return p.filter(F.col(tier).isNotNull()).groupBy(year, tier).agg(
        *[A.mean_of(c, scale).alias(f"mean_{c}") for c in cols], F.count(F.lit(1)).alias("n"))


def effectiveness(p: DataFrame, year="yr", tier="tier", flag_col="pv", scale=None) -> dict:
    """Tier trajectory, tier share per year, turning-point rate per year."""
    return {"trajectory": trajectory(p, year, tier, scale=scale),
            "tier_share": A.group_share(p, year, tier),
            "flag_rate": A.conditional_share(p, year, F.col(flag_col) == "Sim")}


def segments(p: DataFrame, keys: Sequence[str], cols: Sequence[str], scale=None) -> DataFrame:
    """The same means per several segment keys, stacked as
    (key, value, means…, n): every row is unfolded into its keys, one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    d = p.select(*cols, pairs.alias("__kv")).select(*cols, "__kv.key", "__kv.value").filter(F.col("value").isNotNull())
    return d.groupBy("key", "value").agg(*[A.mean_of(c, scale).alias(f"mean_{c}") for c in cols],
                                         F.count(F.lit(1)).alias("n"))


def overview(p: DataFrame, cols: Sequence[str], tier="tier", year="yr", index="inde", scale=None) -> dict:
    """Tier mix, index histogram, panorama, best/worst, movers, radar."""
    from panelkit.operators.joins import reindex_groups
    ym = p.groupBy(year).agg(*[A.mean_of(c, scale).alias(c) for c in cols])
    return {"tier_mix": A.value_counts(p, tier), "index_hist": S.histogram(p, index, 15),
            "panorama": A.column_stats(p, cols, scale), "best_worst": A.best_worst(p, cols, scale),
            "movers": W.biggest_mover(ym, year, cols),
            "radar": reindex_groups(A.group_means(p, [tier], cols, scale), tier, C.TIER_ORDER)}


def profile_360(p: DataFrame, entity="entity_id", year="yr", missing_tier_as_zero: bool = True,
                scores: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per entity: latest values, tier and its change, history,
    alert, recommendations and message; ``scores`` adds the columns of scored
    tables (entity, year, …), matched on the latest row. A missing current
    tier counts as ordinal 0, as in the source (D21). History is gathered per
    entity — bounded by the number of years — then sorted."""
    from pyspark.sql import Window
    from panelkit.functions.bands import inde_message
    from panelkit.operators.rules import alert_levels, recommendations
    w = Window.partitionBy(entity).orderBy(F.desc(year))
    q = p.withColumn("tier_ord", F.coalesce("tier_ord", F.lit(0))) if missing_tier_as_zero else p
    known = q.withColumn("__known", F.nullif(F.col("tier_ord"), F.lit(0)))
    prev = F.last("__known", ignorenulls=True).over(
        Window.partitionBy(entity).orderBy(year).rowsBetween(Window.unboundedPreceding, -1))
    ch = known.withColumn("tier_change", F.coalesce(F.col("tier_ord") - prev, F.lit(0))).drop("__known")
    latest = ch.withColumn("__rk", F.row_number().over(w)).filter("__rk = 1").drop("__rk")
    hist = p.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(year, "inde"))).alias("history"))
    al = alert_levels(latest, keep=[entity, year, "inde", "ieg", "ips", "ida", "iaa", "tier", "tier_change"], missing_as="zero")
    out = (al.join(hist, entity)
           .withColumn("recommendations", recommendations())
           .withColumn("message", inde_message("inde")))
    for df in (scores or {}).values():
        out = out.join(df, [entity, year], "left")
    return out
