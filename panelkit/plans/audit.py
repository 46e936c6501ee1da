"""Data-quality and leakage audit (R19, R20, J8) as one table of
(check, passed, observed) rows, checks on one table share a pass."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["panel_audit", "leakage_screen"]


def leakage_screen(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.5) -> DataFrame:
    """|corr(feature, target)| per feature, flagged above ``limit``."""
    one = df.agg(*[F.round(F.corr(F.col(f).cast("double"), F.col(target).cast("double")), 6).alias(f) for f in features])
    long = one.unpivot([], list(features), "feature", "r")
    return long.withColumn("suspect", F.coalesce(F.abs("r") > F.lit(limit), F.lit(False)))


def panel_audit(p: DataFrame, indicators: Sequence[str], keys: Sequence[str], year: str, years: tuple[int, int],
                category: str, categories: Sequence[str], transitions: DataFrame, split: DataFrame,
                features: dict[str, tuple[DataFrame, Sequence[str]]], excluded: Sequence[tuple[str, str, str]],
                leak_limit: float = 0.5) -> DataFrame:
    """Rows, null and repeated keys, 0–10 ranges, tenure sign, column
    types, spelling of the category, nulls per key column, rows outside the
    stated years, binary target, train/test overlap and stratification (J8),
    the leakage screen of every model (R20) and features made from columns
    that decide the target. Panel, target and split take one aggregation
    each; a screen one per model."""
    first, last = years
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        sum((F.count_if((F.col(c) < 0) | (F.col(c) > 10)) for c in indicators), F.lit(0)).alias("out"),
        F.count_if(F.col("tenure") < 0).alias("tenure"),
        F.count_if(F.col(category).isNotNull() & ~F.col(category).isin(*categories)).alias("spelling"))
    types = sum(1 for c in indicators if dict(p.dtypes)[c] != "double")
    panel = per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_present"),
        F.coalesce(F.sum(F.when(any_null, F.col("rows"))), F.lit(0)).alias("no_null_keys"),
        *[F.coalesce(F.sum(F.when(F.col(k).isNull(), F.col("rows"))), F.lit(0)).alias(f"no_null_{k}") for k in keys],
        F.count_if(F.col("rows") > 1).alias("unique_keys"), F.coalesce(F.sum("out"), F.lit(0)).alias("indicators_in_0_10"),
        F.coalesce(F.sum("tenure"), F.lit(0)).alias("tenure_non_negative"),
        F.coalesce(F.sum("spelling"), F.lit(0)).alias("category_spelling"),
        F.coalesce(F.sum(F.when(~F.col(year).between(first, last), F.col("rows"))), F.lit(0)).alias("rows_outside_years"),
        F.lit(types).alias("indicator_types"), F.lit(len(excluded)).alias("excluded_inputs"))
    target = transitions.agg(F.count_if(~F.col("label").isin(0, 1)).alias("binary_target"))
    parts = split.groupBy(*keys).agg(F.count_if(F.col("is_test") == 1).alias("te"), F.count_if(F.col("is_test") == 0).alias("tr"),
                                     F.count_if((F.col("is_test") == 1) & (F.col("label") == 1)).alias("te1"),
                                     F.count_if((F.col("is_test") == 0) & (F.col("label") == 1)).alias("tr1"))
    halves = parts.agg(
        F.count_if((F.col("te") > 0) & (F.col("tr") > 0)).alias("split_disjoint"),
        F.round(F.abs(F.try_divide(F.sum("te1"), F.sum("te")) - F.try_divide(F.sum("tr1"), F.sum("tr"))), 6)
        .alias("split_stratified"))
    zero = ["no_null_keys", *[f"no_null_{k}" for k in keys], "unique_keys", "indicators_in_0_10", "tenure_non_negative",
            "category_spelling", "rows_outside_years", "indicator_types", "excluded_inputs", "binary_target", "split_disjoint"]
    frames = [panel, target, halves] + [
        leakage_screen(df, cols, "label", leak_limit).agg(F.max(F.abs("r")).alias(f"leakage_{model}"))
        for model, (df, cols) in features.items()]
    rows = [f.select(*[F.col(c).cast("double").alias(c) for c in f.columns]).unpivot([], f.columns, "check", "observed") for f in frames]
    out = reduce(DataFrame.unionByName, rows)
    o = F.col("observed")
    passed = (F.when(F.col("check") == "rows_present", o > 0).when(F.col("check").isin(*zero), o == 0)
              .when(F.col("check") == "split_stratified", o <= F.lit(0.01)).otherwise(o <= F.lit(leak_limit)))
    return out.select("check", passed.alias("passed"), "observed")
