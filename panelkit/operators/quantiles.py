"""Exact quantiles of unbounded domains by distributed selection.

``median``/``percentile`` keep a map of a group's values in one task. Here no task
holds a group's values: the rank that a quantile needs is looked for in an interval
of values, which starts at the group's minimum and maximum. Every step counts the
values of all intervals in ``bins`` equal parts (one aggregation, map-side combined,
so a task sends at most ``bins`` rows an interval), takes the part that holds the
rank, and narrows the interval to the smallest and largest value found in it. An
interval of one value is the answer. As its ends are values of the table, every
step leaves out at least one of them, and the range shrinks by about ``bins`` a step
(parts are equal on a logarithmic scale where an interval spans magnitudes).

Defined results
---------------
* Missing values and NaN do not count; a group without values has NULL quantiles.
  ``-0.0`` counts as ``0.0``; infinities are values like any other.
* Interpolation is linear between neighbouring ranks (``how="linear"``), or the
  value at or above the rank ``ceil(level * n)`` (``how="lower"``, an element of
  the data).
* A missing group key is a group. An empty table gives no rows, or with no keys
  one row of NULLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

__all__ = ["exact_quantiles", "column_quantiles"]

#: parts that an interval is counted in
BINS = 512
#: ranks looked for up to which their intervals are sent to the rows; beyond, the rows move
#: to their group's intervals
SENT_RANKS = 20_000
#: narrowing steps after which a search is taken to be in error
MAX_STEPS = 2000


def exact_quantiles(df: DataFrame, col: str, levels: Sequence[float], keys: Sequence[str] = (), how: str = "linear",
                    bins: int = BINS) -> DataFrame:
    """One row per group: ``keys``, ``n`` and ``quantiles`` (in the order of ``levels``)."""
    levels, names = [float(v) for v in levels], [f"__g{i}" for i in range(len(keys))]
    if how not in ("linear", "lower") or any(not 0 <= v <= 1 for v in levels) or bins < 2:
        raise ValueError("levels lie in [0, 1], how is linear or lower, bins are 2 at least")
    x = F.col(col).cast("double")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.when(~F.isnan(x), x + F.lit(0.0)).alias("x"))
    size = rows.groupBy(*names).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    size = cut_lineage(size)
    # the ranks that the levels need, from 1
    at = [F.lit(v) * (F.col("n") - 1) for v in levels]
    need = F.array(*[r for a in at for r in (F.floor(a) + 1, F.ceil(a) + 1)]) if how == "linear" else F.array(
        *[F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(v) * F.col("n") - F.lit(1e-9))) for v in levels])
    state = size.where("n > 0").select(*names, F.explode(F.array_distinct(need)).alias("rank"), "lo", "hi",
                                       F.lit(0).cast("long").alias("below"))
    open_, done = cut_lineage(state), []
    for _ in range(MAX_STEPS):
        done.append(open_.where("lo = hi").select(*names, "rank", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")
        ranks = open_.count()
        if not ranks:
            break
        open_ = cut_lineage(_narrowed(rows, open_, names, bins, ranks <= SENT_RANKS))
    else:
        raise RuntimeError("a quantile was not found")
    found = reduce(DataFrame.unionByName, done).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    both = _same(size, found, names, "left")
    get = lambda r: F.try_element_at("at", r.cast("long"))
    if how == "linear":
        q = [get(F.floor(a) + 1) + F.when(F.floor(a) == a, F.lit(0.0)).otherwise((get(F.ceil(a) + 1) - get(F.floor(a) + 1)) * (a - F.floor(a)))
             for a in at]
    else:
        q = [get(F.greatest(F.lit(1), F.ceil(F.lit(v) * F.col("n") - F.lit(1e-9)))) for v in levels]
    return both.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", F.array(*q).alias("quantiles"))


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joined on equal keys, missing ones among them; without keys, with the one row
    of the other side."""
    right = right.withColumnsRenamed({n: f"__r{n}" for n in names}) if names else right
    cond = [F.col(n).eqNullSafe(F.col(f"__r{n}")) for n in names] if names else F.lit(True)
    return left.join(right, cond, how).drop(*[f"__r{n}" for n in names])


def _narrowed(rows: DataFrame, state: DataFrame, names: list[str], bins: int, sent: bool = True) -> DataFrame:
    """Every rank's interval narrowed to the values of the part that holds it. With few
    ranks (``sent``) the rows stay where they are: a group may hold most of them."""
    few = F.broadcast if sent else lambda d: d
    # ranks of one group that share an interval are counted once; what only depends on an
    # interval is worked out once for it, so that a row's part is a short expression
    spans = state.select(*[F.col(n).alias(f"__r{n}") for n in names], *[F.col(c).alias(f"s_{c}") for c in ("lo", "hi", "below")]).distinct()
    lo, hi = F.col("s_lo"), F.col("s_hi")
    spans = spans.withColumn("s_most", F.greatest(F.abs(lo), F.abs(hi))).withColumn("s_scale", _scale())
    spans = spans.withColumn("s_from", _place(lo)).withColumn("s_width", F.nullif(_place(hi) - F.col("s_from"), F.lit(0.0)))
    at = [F.col(n).eqNullSafe(F.col(f"__r{n}")) for n in names] + [F.col("x") >= lo, F.col("x") <= hi]
    inside = rows.join(few(spans), reduce(lambda a, b: a & b, at))
    share = F.coalesce(F.nanvl((_place(F.col("x")) - F.col("s_from")) / F.col("s_width"), F.lit(0.5)), F.lit(0.5))
    part = F.when(F.col("x") == lo, 0).when(F.col("x") == hi, bins - 1).otherwise(
        F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins))).cast("int"))
    span = [*[f"__r{n}" for n in names], "s_lo", "s_hi", "s_below"]
    counts = inside.select(*span, "x", part.alias("part")).groupBy(*span, "part").agg(
        F.count(F.lit(1)).alias("c"), F.min("x").alias("lo2"), F.max("x").alias("hi2"))
    w = Window.partitionBy(*span).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.col("s_below") + F.sum("c").over(w)).withColumn("before", F.col("upto") - F.col("c"))
    cond = [F.col(n).eqNullSafe(F.col(f"__r{n}")) for n in names] + [
        F.col("lo") == lo, F.col("hi") == hi, F.col("below") == F.col("s_below"),
        F.col("rank") > F.col("before"), F.col("rank") <= F.col("upto")]
    return few(state).join(counts, reduce(lambda a, b: a & b, cond)).select(
        *names, "rank", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("before").alias("below"))


def _scale():
    """The scale of an interval, one that no order of magnitude can exhaust: logarithmic
    on both sides of zero (0) or on one side of it where the ends are far apart (1),
    else linear (2)."""
    lo, hi = F.col("s_lo"), F.col("s_hi")
    far = F.col("s_most") / F.least(F.abs(lo), F.abs(hi)) > 1024.0
    return F.when((lo <= 0) & (hi >= 0), 0).when(far, 1).otherwise(2)


def _place(x):
    """Where x lies on its interval's scale (linear: halved, as differences may overflow)."""
    around = F.signum(x) * F.log1p(F.abs(x) / F.col("s_most") * F.lit(1e15))
    return F.when(F.col("s_scale") == 2, x / 2).when(F.col("s_scale") == 1, F.signum(x) * F.log(F.abs(x))).otherwise(around)


def column_quantiles(df: DataFrame, cols: Sequence[str], levels: Sequence[float], how: str = "linear", bins: int = BINS) -> DataFrame:
    """The quantiles of several columns in one search: ``column``, ``n``, ``quantiles``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s"))
    return exact_quantiles(long.select("s.*"), "x", levels, ["column"], how, bins)
