"""Cleaning, projection and fill operators."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.core import nan_to_null, to_double
from panelkit.functions.text import canonical_tier, null_tokens, replace_tokens

__all__ = ["rename_columns", "coerce_numeric", "repair_tokens", "add_missing_columns",
           "keep_anchor", "complete_cases", "fill_constant", "median_fill",
           "mode_fill", "backup_columns", "scatter_points", "canonicalise_tier", "nan_to_nulls"]


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename by map; names absent from the frame are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def coerce_numeric(df: DataFrame, cols: Iterable[str], decimal_comma: bool = False) -> DataFrame:
    """Text → double with bad text → NULL, only for columns present."""
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: to_double(c, decimal_comma) for c in cols})


def nan_to_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN → NULL on float columns."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in cols})


def repair_tokens(df: DataFrame, cols: Iterable[str], mapping: dict, tokens=None) -> DataFrame:
    """Junk tokens → NULL, then whole-value replacement."""
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: replace_tokens(null_tokens(c, tokens), mapping) for c in cols})


def canonicalise_tier(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One accented spelling per tier."""
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: canonical_tier(c) for c in cols})


def add_missing_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """P5: add absent optional columns as typed literals.
    ``defaults`` maps name → (value, spark type string)."""
    add = {c: F.lit(v).cast(t) for c, (v, t) in defaults.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def keep_anchor(df: DataFrame, col: str) -> DataFrame:
    """Keep rows where the anchor indicator is present."""
    return df.filter(F.col(col).isNotNull())


def complete_cases(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop rows missing any of ``cols`` (pushes down as IsNotNull)."""
    return df.dropna(subset=list(cols))


def fill_constant(df: DataFrame, value, cols: Iterable[str]) -> DataFrame:
    """Fill with a constant."""
    return df.fillna(value, subset=list(cols))


def median_struct(df: DataFrame, cols: Iterable[str], exact: bool = True) -> Column:
    """One scalar subquery holding every column's median as a struct field.
    Exact ``median`` keeps a value→count map per column — bounded for scores
    with limited precision; ``exact=False`` uses ``approx_percentile`` for
    unbounded domains."""
    aggs = [(F.median(c) if exact else F.approx_percentile(c, 0.5, 10000)).cast("double").alias(c) for c in cols]
    return df.select(F.struct(*aggs)).scalar()


def median_fill(df: DataFrame, cols: Iterable[str], fit_on: DataFrame | None = None,
                exact: bool = True) -> DataFrame:
    """P20: fill missing with the median fitted on ``fit_on`` (default ``df``);
    fit on the training part only to avoid leakage (D23). All medians come
    from one subquery, attached once as a column and read field by field."""
    cols = list(cols)
    src = fit_on if fit_on is not None else df
    out = df.withColumn("__med", median_struct(src, cols, exact))
    out = out.withColumns({c: F.coalesce(F.col(c), F.coalesce(F.col("__med").getField(c), F.lit(0.0))) for c in cols})
    return out.drop("__med")


def mode_fill(df: DataFrame, cols: Iterable[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing with the most frequent value (ties → smallest)."""
    src = fit_on if fit_on is not None else df
    return df.withColumns({c: F.coalesce(F.col(c), src.select(F.mode(c, deterministic=True)).scalar())
                           for c in cols})


def backup_columns(df: DataFrame, cols: Iterable[str], suffix: str = "_ORIG") -> DataFrame:
    """Keep a copy of columns before cleaning."""
    return df.withColumns({f"{c}{suffix}": F.col(c) for c in cols})


def scatter_points(df: DataFrame, x: str, y: str, colour: str | None = None,
                   fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Complete (x, y) pairs, colour median-filled; optional sample for
    plotting very large panels (sampling is the feature here)."""
    pts = df.dropna(subset=[x, y])
    cols = [x, y]
    if colour:
        pts = median_fill(pts, [colour])
        cols.append(colour)
    pts = pts.select(*cols)
    return pts.sample(fraction=fraction, seed=seed) if fraction else pts
