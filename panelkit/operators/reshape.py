"""Reshapes: union, wide↔long, melt, transpose."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["wide_to_long", "long_to_wide", "melt", "transpose_means", "append_snapshot",
           "explode_history"]


def wide_to_long(df: DataFrame, id_cols: Sequence[str], measures: Sequence[str],
                 years: Sequence[int], year_col: str = "yr", anchor: str | None = None,
                 sep: str = "_") -> DataFrame:
    """``{measure}{sep}{year}`` columns → one row per (id, year).

    Built as one ``stack`` generator in a single scan (no per-year rescans,
    no row loop). Measures absent for a year come out NULL. With ``anchor``
    set, rows whose anchor measure is NULL are dropped (P8)."""
    present = set(df.columns)
    blocks = []
    for y in years:
        vals = [f"`{m}{sep}{y}`" if f"{m}{sep}{y}" in present else "NULL" for m in measures]
        blocks.append(", ".join([f"CAST({y} AS INT)"] + vals))
    stack = f"stack({len(years)}, {', '.join(blocks)}) AS ({year_col}, {', '.join(measures)})"
    out = df.select(*id_cols, F.expr(stack))
    return out.filter(F.col(anchor).isNotNull()) if anchor else out


def long_to_wide(df: DataFrame, id_cols: Sequence[str], year_col: str, measures: Sequence[str],
                 years: Sequence[int], sep: str = "_") -> DataFrame:
    """Inverse of U2 with an explicit year list (no distinct-values job):
    conditional ``first`` per (measure, year) in one aggregation."""
    aggs = [F.first(F.when(F.col(year_col) == y, F.col(m)), ignorenulls=True).alias(f"{m}{sep}{y}")
            for m in measures for y in years]
    return df.groupBy(*id_cols).agg(*aggs)


def melt(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
         var_name: str = "indicator", value_name: str = "value", dropna: bool = False) -> DataFrame:
    """Indicators → (name, value) rows."""
    out = df.unpivot(list(id_cols), list(value_cols), var_name, value_name)
    return out.filter(F.col(value_name).isNotNull()) if dropna else out


def transpose_means(df: DataFrame, group: str, cols: Iterable[str], groups: Sequence,
                    var_name: str = "indicator", scale: int | None = None) -> DataFrame:
    """U4: group means transposed to indicator × group. Melt, then one
    aggregation with a conditional mean per known group value (no pivot
    discovery pass)."""
    from panelkit.operators.aggregates import mean_of
    long = df.filter(F.col(group).isNotNull()).unpivot([group], list(cols), var_name, "value")
    return long.groupBy(var_name).agg(
        *[mean_of(F.when(F.col(group) == g, F.col("value")), scale).alias(str(g)) for g in groups])


def explode_history(df: DataFrame, map_col: str, key_name: str = "yr",
                    value_name: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """a ``map<year, value>`` column → one row per entry."""
    return df.select(*keep, F.explode(map_col).alias(key_name, value_name))


def append_snapshot(long_df: DataFrame, snapshot: DataFrame, entity: str, year_col: str,
                    snapshot_year: int) -> DataFrame:
    """Add snapshot rows (one per entity, no year column) to the long
    panel under an explicit ``snapshot_year``, plus ``dup_year`` = 1 when the
    entity already has a row for that year (the source labels its snapshot
    2024 while the values are the 2022 columns; here the year is a parameter
    and clashes are flagged, not silently doubled)."""
    snap = snapshot.withColumn(year_col, F.lit(int(snapshot_year)))
    out = long_df.unionByName(snap, allowMissingColumns=True)
    from pyspark.sql import Window
    w = Window.partitionBy(entity, year_col)
    return out.withColumn("dup_year", (F.count(F.lit(1)).over(w) > 1).cast("int"))
