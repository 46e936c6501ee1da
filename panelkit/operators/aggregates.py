"""Descriptive aggregations.

Every statistic of one report is computed in one ``agg`` (one pass, map-side
partial aggregation), never one job per statistic. ``scale`` switches a mean
to the exact scaled-long form for values with at most ``scale`` decimals
(results then do not depend on partitioning or summation order).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.bands import null_share_status
from panelkit.functions.core import exact_mean

__all__ = ["mean_of", "kpi_row", "group_count", "value_counts", "counts_by_key", "year_stats",
           "group_means", "mean_std", "group_share", "conditional_share", "column_stats",
           "best_worst", "null_profile", "class_balance", "guarded_mean", "count_above_mean",
           "mean_gap", "distinct_sorted", "tier_count_by_year", "group_difference",
           "flag_volumes", "top_share", "share_expr"]


def mean_of(c, scale: int | None = None) -> Column:
    return exact_mean(c, scale) if scale is not None else F.avg(c)


def share_expr(cond: Column) -> Column:
    """Share in % with NULL counted in the denominator."""
    return F.try_divide(F.count_if(F.coalesce(cond, F.lit(False))).cast("double"),
                        F.count(F.lit(1)).cast("double")) * F.lit(100.0)


def kpi_row(df: DataFrame, index: str, flag_true: Column, lag_cond: Column, perf: str,
            scale: int | None = None) -> DataFrame:
    """A1: one KPI row — rows, mean index, flag share, lag share, mean perf."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  mean_of(index, scale).alias("mean_index"),
                  share_expr(flag_true).alias("flag_share"),
                  share_expr(lag_cond).alias("lag_share"),
                  mean_of(perf, scale).alias("mean_perf"))


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """A2: rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A3: frequency table, NULL dropped (D3), most frequent first; ties by
    key for a deterministic order."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(col)))


def counts_by_key(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A4: frequency table in key order."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(col))


def median_of(col: str, exact: bool = True) -> Column:
    """Median: exact (a value → count map per group, small for scores of limited
    precision), or for unbounded domains the approximate percentile."""
    return F.median(col) if exact else F.percentile_approx(col, 0.5, 10_000).cast("double")


def year_stats(df: DataFrame, year: str, col: str, scale: int | None = None, digits: int = 6, exact: bool = True) -> DataFrame:
    """A5: mean / median / sample std per year (exact median by default, D5, D6)."""
    return df.groupBy(year).agg(mean_of(col, scale).alias("mean"),
                                F.round(median_of(col, exact), digits).alias("median"),
                                F.round(F.stddev_samp(col), digits).alias("std"),
                                F.count(col).alias("n"))


def group_means(df: DataFrame, keys: Sequence[str], cols: Iterable[str],
                scale: int | None = None, drop_null_keys: bool = True) -> DataFrame:
    """Mean of several indicators per group; NULL keys dropped like
    pandas ``groupby`` (D3)."""
    if drop_null_keys:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(*[mean_of(c, scale).alias(f"mean_{c}") for c in cols])


def mean_std(df: DataFrame, keys: Sequence[str], col: str, scale: int | None = None,
             digits: int = 6) -> DataFrame:
    """Mean + sample std per group."""
    return (df.dropna(subset=list(keys)).groupBy(*keys)
            .agg(mean_of(col, scale).alias("mean"), F.round(F.stddev_samp(col), digits).alias("std"),
                 F.count(col).alias("n")))


def group_share(df: DataFrame, by: str, cat: str, digits: int = 1) -> DataFrame:
    """A8 (+A2, J1): share of each category within ``by``.

    The denominator counts *all* rows of the ``by`` group, NULL categories
    included (D4). Counts per (by, cat) first, then the group total as a
    window over that small aggregate — both partitioned on ``by``, so there is
    one shuffle of pre-aggregated rows and no join. Rounded half-even (D8)."""
    counts = df.groupBy(by, cat).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy(by)
    out = counts.withColumn("total", F.sum("n").over(w))
    out = out.withColumn("pct", F.bround(F.col("n").cast("double") / F.col("total") * F.lit(100.0), digits))
    return out.filter(F.col(cat).isNotNull())


def conditional_share(df: DataFrame, by: str, cond: Column, name: str = "pct") -> DataFrame:
    """% of rows meeting ``cond`` per group, NULL as not met."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(cond, F.lit(False))).alias("n_true"),
        share_expr(cond).alias(name))


def column_stats(df: DataFrame, cols: Iterable[str], scale: int | None = None,
                 digits: int = 6, exact: bool = True) -> DataFrame:
    """A10: mean / median / std of each column from one pass, as rows."""
    cols = list(cols)
    aggs = []
    for c in cols:
        aggs += [mean_of(c, scale).alias(f"{c}__mean"), F.round(median_of(c, exact), digits).alias(f"{c}__median"),
                 F.round(F.stddev_samp(c), digits).alias(f"{c}__std")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(f"{c}__mean").alias("mean"),
                 F.col(f"{c}__median").alias("median"), F.col(f"{c}__std").alias("std"))
        for c in cols])).alias("s")).select("s.*")


def best_worst(df: DataFrame, cols: Iterable[str], scale: int | None = None, digits: int = 6) -> DataFrame:
    """Indicator with the best and worst mean and with the largest std
    (ties → first name in alphabetical order, deterministic)."""
    st = column_stats(df, cols, scale, digits)
    ind = F.col("indicator")
    return st.agg(
        F.min_by(ind, F.when(F.col("mean").isNotNull(), F.struct(-F.col("mean"), ind))).alias("best"),
        F.min_by(ind, F.when(F.col("mean").isNotNull(), F.struct(F.col("mean"), ind))).alias("worst"),
        F.min_by(ind, F.when(F.col("std").isNotNull(), F.struct(-F.col("std"), ind))).alias("most_spread"))


def null_profile(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Nulls per column, share and status, from one pass."""
    cols = list(cols)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = one.unpivot(["__n"], cols, "column", "nulls")
    pct = F.round(F.try_divide(F.col("nulls").cast("double"), F.col("__n").cast("double")) * F.lit(100.0), 4)
    return long.select("column", "nulls", pct.alias("pct"), null_share_status(pct).alias("status"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """n0, n1, ratio n0/n1 and positive rate."""
    return df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).select(
        "n0", "n1", F.try_divide(F.col("n0").cast("double"), F.col("n1").cast("double")).alias("ratio"),
        F.try_divide(F.col("n1").cast("double"), (F.col("n0") + F.col("n1")).cast("double")).alias("rate"))


def guarded_mean(df: DataFrame, year: str, col: str, min_count: int = 50,
                 scale: int | None = None) -> DataFrame:
    """Per-year mean only where more than ``min_count`` values exist."""
    return (df.groupBy(year).agg(mean_of(col, scale).alias("mean"), F.count(col).alias("n"))
            .filter(F.col("n") > min_count))


def count_above_mean(df: DataFrame, col: str, scale: int | None = None) -> DataFrame:
    """Rows above the column's own mean; the mean is a scalar subquery
    (evaluated once), not an unpartitioned window."""
    m = df.select(mean_of(col, scale)).scalar()
    return df.agg(F.count_if(F.col(col) > m).alias("n_above"), F.count(col).alias("n"))


def mean_gap(a: str, b: str, scale: int | None = None) -> Column:
    """Mean of a − b over complete pairs (as an aggregate column)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return mean_of(F.when(both, F.col(a) - F.col(b)), scale)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def tier_count_by_year(df: DataFrame, tier_cols: dict, tiers: Sequence[str]) -> DataFrame:
    """Tier counts per year from year-suffixed tier columns
    (``{year: column}``), spellings merged, each row counted once, on the
    complete (year × tier) grid (missing combinations → 0)."""
    from panelkit.functions.text import canonical_tier
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(int(y)).alias("yr"), canonical_tier(c).alias("tier")) for y, c in tier_cols.items()
    ])).alias("s")).select("s.*").filter(F.col("tier").isin(*tiers))
    counts = stacked.groupBy("yr", "tier").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(int(y), t) for y in tier_cols for t in tiers], "yr int, tier string")
    return F.broadcast(grid).join(counts, ["yr", "tier"], "left").fillna(0, ["n"])


def group_difference(df: DataFrame, group: str, a, b, cols: Iterable[str],
                     scale: int | None = None, eps: float = 0.3) -> DataFrame:
    """Per indicator, mean in group ``a`` minus mean in group ``b`` with
    a parity verdict (|diff| < eps) — one pass, conditional means."""
    cols = list(cols)
    aggs = []
    for c in cols:
        aggs += [mean_of(F.when(F.col(group) == a, F.col(c)), scale).alias(f"{c}__a"),
                 mean_of(F.when(F.col(group) == b, F.col(c)), scale).alias(f"{c}__b")]
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(f"{c}__a").alias("mean_a"), F.col(f"{c}__b").alias("mean_b"))
        for c in cols])).alias("s")).select("s.*")
    diff = F.col("mean_a") - F.col("mean_b")
    return rows.select("indicator", "mean_a", "mean_b", diff.alias("diff"),
                       F.when(F.abs(diff) < F.lit(eps), F.lit("parity"))
                       .when(diff > 0, F.lit("a_higher")).when(diff < 0, F.lit("b_higher")).alias("verdict"))


def flag_volumes(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows raise each flag, largest first."""
    one = df.agg(*[F.sum(F.col(f)).cast("long").alias(f) for f in flags])
    return one.unpivot([], list(flags), "signal", "n").orderBy(F.desc("n"), F.asc("signal"))


def top_share(df: DataFrame, col: str, group_set: Sequence) -> DataFrame:
    """Most frequent category, its share, and the share of a set of
    categories (NULLs excluded from the denominator, like value_counts)."""
    vc = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").cast("double")
    return vc.agg(
        F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias("top"),
        F.try_divide(F.max("n").cast("double"), total).alias("top_share"),
        F.try_divide(F.sum(F.when(F.col(col).isin(*group_set), F.col("n"))).cast("double"), total).alias("set_share"))
