"""Statistics (A12–A21, W5): correlation, OLS, histograms, box, density.

All fitted scalars (min, max, bandwidth) enter row expressions either as a
scalar subquery or through a join on the (small) group key — never through
the driver.
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["corr_pair", "corr_matrix", "corr_lower", "corr_target", "rank_by_abs", "ols_line",
           "line_grid", "histogram", "right_closed_bins", "binned_means", "box_summary",
           "density_grid", "density_binned"]


def corr_pair(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Pearson r on complete pairs (Spark ``corr`` skips incomplete)."""
    agg = [F.round(F.corr(x, y), digits).alias("r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n")]
    return df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Full matrix as (x, y, r) rows; every pair is one ``corr`` inside a
    single aggregation pass, mirrored, with 1.0 on the diagonal."""
    cols = list(cols)
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.round(F.corr(a, b), digits).alias(f"{a}__{b}") for a, b in pairs])
    items = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    items += [F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    items += [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")) for c in cols]
    return one.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def corr_lower(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the strict lower triangle (ordinal(x) > ordinal(y))."""
    from panelkit.functions.bands import map_lookup
    order = {c: i for i, c in enumerate(cols)}
    return matrix.filter(map_lookup("x", order) > map_lookup("y", order))


def corr_target(df: DataFrame, target: str, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Correlation of each column with the target (target dropped)."""
    cols = [c for c in cols if c != target]
    one = df.agg(*[F.round(F.corr(c, target), digits).alias(c) for c in cols])
    return one.unpivot([], cols, "indicator", "r")


def rank_by_abs(corrs: DataFrame, value: str = "r", name: str = "indicator") -> DataFrame:
    """Rank by |r| descending (ties by name). Runs on the small result of
    A15, so the unpartitioned window sees one row per indicator."""
    w = Window.orderBy(F.desc(F.abs(F.col(value))), F.asc(name))
    return corrs.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w))


def ols_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Slope, intercept, R², n of y ~ x on complete pairs."""
    agg = [F.round(F.regr_slope(y, x), digits).alias("slope"),
           F.round(F.regr_intercept(y, x), digits).alias("intercept"),
           F.round(F.regr_r2(y, x), digits).alias("r2"),
           F.regr_count(y, x).alias("n")]
    return df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)


def line_grid(df: DataFrame, x: str, y: str, points: int = 100, digits: int = 6) -> DataFrame:
    """Fitted line evaluated on ``points`` evenly spaced x values
    between min and max of x (complete pairs)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
                 F.min(F.when(both, F.col(x))).alias("lo"), F.max(F.when(both, F.col(x))).alias("hi"))
    g = fit.select("a", "b", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    gx = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    return g.select("i", F.round(gx, digits).alias("x"), F.round(F.col("a") + F.col("b") * gx, digits).alias("y"))


def histogram(df: DataFrame, col: str, bins: int, group: str | None = None, digits: int = 6) -> DataFrame:
    """Equal-width histogram over [min, max] with ``bins`` bins (last
    bin right-closed, as numpy). min/max are scalar subqueries."""
    mm = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    d = df.filter(F.col(col).isNotNull()).withColumn("__mm", mm)  # the subquery is attached once
    lo, hi = F.col("__mm.lo"), F.col("__mm.hi")
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - lo) / width).cast("int"), F.lit(bins - 1)))
    keys = ([group] if group else []) + ["bin"]
    h = d.withColumn("bin", b).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(lo).alias("__lo"),
                                                  F.first(width).alias("__w"))
    return h.select(*keys, F.round(F.col("__lo") + F.col("__w") * F.col("bin"), digits).alias("lo"),
                    F.round(F.col("__lo") + F.col("__w") * (F.col("bin") + 1), digits).alias("hi"), "n")


def right_closed_bins(col: str, edges: Sequence[float]):
    """Labels for (e0,e1], (e1,e2], ...; values ≤ e0 or > last → NULL."""
    c = F.col(col)
    expr = None
    for a, b in zip(edges[:-1], edges[1:]):
        lab = f"({a:g}, {b:g}]"
        cond = (c > F.lit(a)) & (c <= F.lit(b))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def binned_means(df: DataFrame, bin_col: str, edges: Sequence[float], cols: Sequence[str],
                 scale: int | None = None) -> DataFrame:
    """Right-closed bins of one column, then group means."""
    from panelkit.operators.aggregates import mean_of
    return (df.withColumn("bin", right_closed_bins(bin_col, edges)).filter(F.col("bin").isNotNull())
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[mean_of(c, scale).alias(f"mean_{c}") for c in cols]))


def box_summary(df: DataFrame, col: str, group: str, digits: int = 6, exact: bool = True) -> DataFrame:
    """Quartiles (exact, linear; or approximate percentiles for unbounded
    domains), whiskers at the most extreme values
    inside 1.5·IQR, and the outlier count, per group. Rows are first reduced
    to (group, value, count) on the map side; quartiles, whiskers and outliers
    all come from these counts, so rows are never joined or shuffled on a
    group key with few values."""
    d = df.filter(F.col(col).isNotNull() & F.col(group).isNotNull())
    v = d.groupBy(group, F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    if exact:
        q = v.groupBy(group).agg(F.percentile("__v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("__c")).alias("q"),
                                 F.sum("__c").alias("__n"))
    else:
        q = d.groupBy(group).agg(F.percentile_approx(F.col(col).cast("double"), [0.25, 0.5, 0.75], 10_000).alias("q"),
                                 F.count(F.lit(1)).alias("__n"))
    q = q.select(group, "__n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lf", F.col("q1") - F.lit(1.5) * iqr).withColumn("uf", F.col("q3") + F.lit(1.5) * iqr)
    x = F.col("__v")
    out = v.join(q, group).groupBy(group).agg(
        F.first("__n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(x >= F.col("lf"), x)).alias("whisker_lo"),
        F.max(F.when(x <= F.col("uf"), x)).alias("whisker_hi"),
        F.sum(F.when((x < F.col("lf")) | (x > F.col("uf")), F.col("__c")).otherwise(0)).alias("outliers"))
    return out.select(group, "n", *[F.round(c, digits).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                      "outliers")


def density_grid(df: DataFrame, col: str, group: str, points: int = 100, digits: int = 9) -> DataFrame:
    """Gaussian KDE per group on ``points`` grid points over
    [min, max], Scott bandwidth h = s·n^(-1/5).

    Equal values are pre-aggregated first; each distinct (group, value) row
    then expands to the fixed grid with a generator (``points`` rows each —
    a constant factor, no pairwise join) and is summed per grid point."""
    d = df.filter(F.col(col).isNotNull() & F.col(group).isNotNull())
    vals = d.groupBy(group, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    params = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(col).alias("s"),
                                  F.min(col).alias("lo"), F.max(col).alias("hi"))
    params = params.withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    params = params.filter(F.col("h") > 0)
    j = vals.join(params, group).select(group, "v", "c", "n", "h", "lo", "hi",
                                        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    gx = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    u = (gx - F.col("v")) / F.col("h")
    k = F.col("c") * F.exp(-u * u / F.lit(2.0))
    norm = F.first("n").cast("double") * F.first("h") * F.lit((2 * 3.141592653589793) ** 0.5)
    out = j.groupBy(group, "i").agg(F.first(gx).alias("x"), F.sum(k).alias("ks"), norm.alias("z"))
    return out.select(group, "i", F.round("x", 6).alias("x"), F.round(F.col("ks") / F.col("z"), digits).alias("density"))


def density_binned(df: DataFrame, col: str, group: str, points: int = 100, bins: int = 2000, digits: int = 9) -> DataFrame:
    """A21 for any number of distinct values: the rows are binned linearly to ``bins``
    equal steps over [min, max] of their group (each row's weight is shared by its two
    neighbouring bin edges, one map-side combined aggregate of at most ``bins`` + 1 rows
    a group), and the Gaussian kernel is summed over the edges, with the bandwidth of
    :func:`density_grid`.

    ``bound`` states how far a density may lie from the exact one: the kernel is
    interpolated between edges a step d apart, so d² / (8 √(2π) h³) at most. Missing
    values, NaN and missing groups are left out; a group without spread has no density."""
    x = F.col(col).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x) & F.col(group).isNotNull()).select(F.col(group), x.alias("v"))
    params = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    params = (params.withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where(F.col("h") > 0)
              .withColumn("d", (F.col("hi") - F.col("lo")) / F.lit(float(bins))))
    at = (F.col("v") - F.col("lo")) / F.col("d")
    left = F.least(F.floor(at), F.lit(bins - 1)).cast("int")
    # a row of (group, left edge) holds its rows' number and the sum of their right shares
    cell = d.join(params.select(group, "lo", "d"), group).select(group, left.alias("b"), (at - left).alias("w")).groupBy(group, "b").agg(
        F.count(F.lit(1)).alias("c"), F.sum("w").alias("w"))
    edges = cell.select(group, F.explode(F.array(F.struct(F.col("b").alias("b"), (F.col("c") - F.col("w")).alias("w")),
                                                 F.struct((F.col("b") + 1).alias("b"), F.col("w").alias("w")))).alias("e"))
    edges = edges.groupBy(group, F.col("e.b").alias("b")).agg(F.sum("e.w").alias("w"))
    j = edges.join(params, group).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    gx = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    u = (gx - (F.col("lo") + F.col("d") * F.col("b"))) / F.col("h")
    root = (2 * 3.141592653589793) ** 0.5
    out = j.groupBy(group, "i").agg(
        F.first(gx).alias("x"), (F.sum(F.col("w") * F.exp(-u * u / F.lit(2.0))) / (F.first("n") * F.first("h") * F.lit(root))).alias("density"),
        F.first(F.col("d") * F.col("d") / (F.lit(8.0 * root) * F.pow("h", F.lit(3.0)))).alias("bound"))
    return out.select(group, "i", F.round("x", 6).alias("x"), F.round("density", digits).alias("density"), "bound")
