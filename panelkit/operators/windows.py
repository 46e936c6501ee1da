"""Windows over the panel (W1–W4, W6, W11, W13, W14) and the year-transition
joins (J3, J4).

Every window is partitioned by the entity key. The panel has at most one row
per (entity, year), so a partition is bounded by the number of years even
when one entity dominates the raw data; raw event tables are first reduced to
(entity, day) before a window runs (see :func:`streaks`).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.bands import trend_verdict

__all__ = ["yoy_delta", "latest_prev", "first_last", "series_change", "biggest_mover",
           "first_seen_code", "tier_change_fixed", "tier_change_latest", "streaks",
           "transitions", "leavers", "stayers", "history_of"]


def yoy_delta(df: DataFrame, entity: str, year: str, cols: Sequence[str], consecutive_only: bool = False,
              digits: int | None = 6) -> DataFrame:
    """Value minus the previous observed year's value per entity.
    ``consecutive_only`` gives NULL when the previous row is not year−1."""
    w = Window.partitionBy(entity).orderBy(year)
    prev_year = F.lag(year).over(w)
    out = df
    for c in cols:
        d = F.col(c) - F.lag(c).over(w)
        if consecutive_only:
            d = F.when(prev_year == F.col(year) - 1, d)
        out = out.withColumn(f"d_{c}", F.round(d, digits) if digits is not None else d)
    return out


def latest_prev(df: DataFrame, entity: str, year: str, col: str) -> DataFrame:
    """Latest and previous year's value per entity."""
    w = Window.partitionBy(entity).orderBy(F.desc(year))
    r = df.select(entity, year, col, F.row_number().over(w).alias("rk")).filter(F.col("rk") <= 2)
    return r.groupBy(entity).agg(
        F.max(F.when(F.col("rk") == 1, F.col(year))).alias("latest_year"),
        F.max(F.when(F.col("rk") == 1, F.col(col))).alias("latest"),
        F.max(F.when(F.col("rk") == 2, F.col(year))).alias("prev_year"),
        F.max(F.when(F.col("rk") == 2, F.col(col))).alias("prev"))


def first_last(df: DataFrame, entity: str, year: str, col: str, digits: int = 6) -> DataFrame:
    """W3 per entity: last − first over the observed years, with verdict.
    A plain aggregation (``max_by``/``min_by``) — partial aggregation applies."""
    out = df.filter(F.col(col).isNotNull()).groupBy(entity).agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.min_by(col, year).alias("first"), F.max_by(col, year).alias("last"))
    ch = F.round(F.col("last") - F.col("first"), digits)
    return out.withColumn("change", ch).withColumn("verdict", trend_verdict(ch))


def series_change(series: DataFrame, order: str, value: str, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """W3 on an aggregated series (e.g. yearly means): last − first + verdict."""
    g = series.filter(F.col(value).isNotNull())
    aggs = [F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last")]
    out = g.groupBy(*keys).agg(*aggs) if keys else g.agg(*aggs)
    ch = F.round(F.col("last") - F.col("first"), digits)
    return out.withColumn("change", ch).withColumn("verdict", trend_verdict(ch))


def biggest_mover(yearly_means: DataFrame, year: str, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Indicator with the largest and the smallest first→last change of
    its yearly mean (input: one row per year)."""
    long = yearly_means.unpivot([year], list(cols), "indicator", "value")
    ch = series_change(long, year, "value", ["indicator"], digits)
    ind = F.col("indicator")
    return ch.agg(F.min_by(ind, F.struct(-F.col("change"), ind)).alias("largest_gain"),
                  F.min_by(ind, F.struct(F.col("change"), ind)).alias("largest_drop"))


def first_seen_code(df: DataFrame, col: str, row_id: str) -> DataFrame:
    """Category → code by order of first appearance (0-based). Each
    category's first row id is unique, so the code is a global running count
    over first row ids — computed range-parallel, so a column with millions
    of categories never lands in one task."""
    from panelkit.operators.evaluation import ordered_prefix_sums
    firsts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(row_id).alias("first_row"))
    c = ordered_prefix_sums(firsts.withColumn("__one", F.lit(1)), "first_row", ["__one"])
    return c.select(col, (F.col("cum___one") - 1).cast("int").alias("code"))


def tier_change_fixed(df: DataFrame, entity: str, year: str, ord_col: str, base_year: int,
                      target_year: int, missing_as_zero: bool = True) -> DataFrame:
    """W11 (monitoring form): ordinal(target) − ordinal(base); 0 when either
    is missing (``missing_as_zero``), as the monitoring table does."""
    g = df.groupBy(entity).agg(
        F.max(F.when(F.col(year) == base_year, F.col(ord_col))).alias("base_ord"),
        F.max(F.when(F.col(year) == target_year, F.col(ord_col))).alias("target_ord"))
    ch = F.col("target_ord") - F.col("base_ord")
    return g.withColumn("tier_change", F.coalesce(ch, F.lit(0)) if missing_as_zero else ch)


def tier_change_latest(df: DataFrame, entity: str, year: str, ord_col: str) -> DataFrame:
    """W11 (long form): ordinal minus the latest earlier non-null ordinal."""
    w = Window.partitionBy(entity).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(ord_col, ignorenulls=True).over(w)
    return df.withColumn("prev_ord", prev).withColumn("tier_change", F.col(ord_col) - F.col("prev_ord"))


def streaks(events: DataFrame, entity: str, ts: str, min_run: int = 3) -> DataFrame:
    """Longest run of consecutive active days per entity
    (gaps-and-islands). Events are first reduced to distinct (entity, day),
    so a partition holds at most one row per active day of the entity."""
    days = events.select(entity, F.to_date(ts).alias("day")).distinct()
    w = Window.partitionBy(entity).orderBy("day")
    isl = days.withColumn("island", F.date_sub(F.col("day"), F.row_number().over(w)))
    runs = isl.groupBy(entity, "island").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(entity).agg(F.max("run").alias("longest"), F.count(F.lit(1)).alias("n_runs")).withColumn(
        "reached", F.col("longest") >= F.lit(min_run))


def transitions(df: DataFrame, entity: str, year: str, first_year, last_year) -> DataFrame:
    """J3 (window form): for each (entity, year) with first ≤ year ≤ last
    (numbers or columns, such as scalar subqueries),
    ``left`` = 1 when the entity is absent the following year. One shuffle
    on the entity key instead of a self join on (entity, year+1)."""
    w = Window.partitionBy(entity).orderBy(year)
    nxt = F.lead(year).over(w)
    out = df.withColumn("__next", nxt).filter(F.col(year).between(first_year, last_year))
    left = F.when(F.col("__next").isNull() | (F.col("__next") != F.col(year) + 1), 1).otherwise(0)
    return out.withColumn("left", left).drop("__next")


def leavers(df: DataFrame, entity: str, year: str, first_year, last_year) -> DataFrame:
    """Present in year, absent in year + 1 (a filter on the transitions:
    no self join, no shuffle beyond the entity window)."""
    return transitions(df, entity, year, first_year, last_year).filter("left = 1").drop("left")


def stayers(df: DataFrame, entity: str, year: str, first_year, last_year) -> DataFrame:
    """Present in both years."""
    return transitions(df, entity, year, first_year, last_year).filter("left = 0").drop("left")


def history_of(df: DataFrame, keys: DataFrame, entity: str, year: str) -> DataFrame:
    """Full history of the selected entities (semi join), by year."""
    return df.join(keys.select(entity), entity, "left_semi").orderBy(entity, year)
