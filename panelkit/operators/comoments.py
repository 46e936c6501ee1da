"""Co-moments as a stored, mergeable state.

A state row holds, for one value of the partition key and one pair of columns, the
rows in which both are present: their number, both means, and the sums of squares and
products about these means. States of disjoint rows merge exactly in algebra and, as
they are centred, without the cancellation that sums of raw products suffer from.
Correlations, lines, R² and leakage screens are read from the state, whose size is
pairs x keys whatever the rows. The state is stored with a folder per key, so that a
new year is aggregated by itself and written beside the others; old rows are not read.

Defined results: missing values and NaN take a row out of the pairs that they are in
only; a pair without rows has n = 0 and no correlation; a column without variance has
no correlation. A missing key is a key of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["comoments", "merged", "write_state", "read_state", "correlations", "lines", "target_correlations"]

_VALUES = ["n", "mx", "my", "cxx", "cyy", "cxy"]


def comoments(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The state of ``df``: ``keys, x, y, n, mx, my, cxx, cyy, cxy`` for every pair
    of ``cols`` (x before y in their order, and each with itself). Pairs are rows of
    one small aggregate, map-side combined, not columns of a wide one."""
    v = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), v[a].alias("vx"), v[b].alias("vy"))
                               for a, b in combinations_with_replacement(cols, 2)]))
    rows = df.select(*keys, pair.alias("p")).select(*keys, "p.*")
    both = F.col("vx").isNotNull() & F.col("vy").isNotNull()
    rows = rows.select(*keys, "x", "y", F.when(both, F.col("vx")).alias("vx"), F.when(both, F.col("vy")).alias("vy"))
    n = F.count("vx")
    return rows.groupBy(*keys, "x", "y").agg(
        n.alias("n"), F.avg("vx").alias("mx"), F.avg("vy").alias("my"), (F.var_pop("vx") * n).alias("cxx"),
        (F.var_pop("vy") * n).alias("cyy"), (F.covar_pop("vx", "vy") * n).alias("cxy"))


def merged(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """States of disjoint rows added up, per ``keys`` (none: over all). The parts'
    means are taken about the mean of the whole, in a second step."""
    by = [*keys, "x", "y"]
    whole = states.groupBy(*by).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mx")), F.sum("n")).alias("mx"),
                                    F.try_divide(F.sum(F.col("n") * F.col("my")), F.sum("n")).alias("my"),
                                    F.collect_list(F.struct(*_VALUES)).alias("parts"))  # a row for every stored key
    about = lambda c, a, b, ma, mb: F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.when(
        p["n"] > 0, p[c] + p["n"] * (p[a] - F.col(ma)) * (p[b] - F.col(mb))).otherwise(0.0))
    return whole.select(*by, "n", "mx", "my", about("cxx", "mx", "mx", "mx", "mx").alias("cxx"),
                        about("cyy", "my", "my", "my", "my").alias("cyy"), about("cxy", "mx", "my", "mx", "my").alias("cxy"))


def write_state(df: DataFrame, cols: Sequence[str], key: str, path: str) -> None:
    """Aggregate the rows of ``df`` and store them, a folder for each value of
    ``key``; folders of other values stay as they are. Written for a year that is
    there already, it replaces that year."""
    (comoments(df, cols, [key]).repartition(1, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _r(digits: int | None):
    r = F.try_divide(F.col("cxy"), F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy")))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) if digits is None else F.round(r, digits)
    return F.when(F.col("n") > 1, r)


def correlations(state: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """The full matrix ``keys, x, y, n, r`` read from a (merged) state."""
    half = state.select(*keys, "x", "y", "n", F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(_r(digits)).alias("r"))
    other = half.where("x <> y").select(*keys, F.col("y").alias("x"), F.col("x").alias("y"), "n", "r")
    return half.unionByName(other)


def lines(state: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Slope, intercept and R² of each column on each other: ``keys, x, y, n,
    slope, intercept, r2`` (y explained by x)."""
    pairs = state.where("x <> y")
    turned = pairs.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"), "n", F.col("my").alias("mx"), F.col("mx").alias("my"),
                          F.col("cyy").alias("cxx"), F.col("cxx").alias("cyy"), "cxy")
    slope = F.try_divide(F.col("cxy"), F.nullif(F.col("cxx"), F.lit(0.0)))
    r2 = F.try_divide(F.col("cxy") * F.col("cxy"), F.nullif(F.col("cxx") * F.col("cyy"), F.lit(0.0)))
    return pairs.select(*turned.columns).unionByName(turned).select(
        *keys, "x", "y", "n", F.round(slope, digits).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), digits).alias("intercept"),
        F.round(r2, digits).alias("r2"))


def target_correlations(state: DataFrame, target: str, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Correlation of every other column with the target."""
    return correlations(state, keys, digits).where((F.col("y") == target) & (F.col("x") != target)).select(
        *keys, F.col("x").alias("indicator"), "r")
