"""Seeded stratified split and folds (W7, W8) and per-entity sampling.

A window partitioned by the label alone would put half of a binary table in
one task. Instead rows are ordered inside each stratum by a seeded hash of
their key, and the rank is computed range-parallel: the hash is uniform, so
(stratum, hash bucket) partitions are balanced; bucket offsets come from a
small (strata × buckets) count table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["hash_rank", "stratified_split", "stratified_folds", "sample_per_entity"]


#: hash ranges per stratum; ranks do not depend on it
HASH_RANGES = 1024


def hash_rank(df: DataFrame, strata: str, keys: Sequence[str], seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Adds ``__h`` (seeded hash), ``rank`` (0-based, within stratum, in hash
    order; ties by key) and ``stratum_n``."""
    buckets = buckets or HASH_RANGES
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    # bucket = high-order range of the hash, so bucket order = hash order
    d = df.withColumn("__h", h).withColumn("__b", F.least(F.lit(buckets - 1), F.floor((F.col("__h").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64 / buckets)).cast("int")))
    cnt = d.groupBy(strata, "__b").agg(F.count(F.lit(1)).alias("__c"))
    wo = Window.partitionBy(strata).orderBy("__b")
    cnt = cnt.select(strata, "__b",
                     (F.sum("__c").over(wo.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__off"),
                     F.sum("__c").over(Window.partitionBy(strata)).alias("stratum_n"))
    w = Window.partitionBy(strata, "__b").orderBy("__h", *keys)
    # a missing stratum value is a stratum like any other: null-safe match, no row is lost
    cnt = cnt.withColumnsRenamed({strata: "__s", "__b": "__cb"})
    r = d.join(cnt, F.col(strata).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__cb"))).drop("__s", "__cb")
    return r.withColumn("rank", F.col("__off") + F.row_number().over(w) - 1).drop("__b", "__off")


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_fraction: float = 0.2,
                     seed: int = 42, buckets: int | None = None) -> DataFrame:
    """``is_test`` = 1 for the first ceil(fraction·n_c) rows of each
    class in seeded hash order (exact per-class quota)."""
    r = hash_rank(df, label, keys, seed, buckets)
    quota = F.ceil(F.col("stratum_n") * F.lit(test_fraction))
    return r.withColumn("is_test", (F.col("rank") < quota).cast("int")).drop("__h", "rank", "stratum_n")


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42,
                     buckets: int | None = None) -> DataFrame:
    """``fold`` = rank mod k within each class, so fold sizes per class
    differ by at most one."""
    r = hash_rank(df, label, keys, seed + 1, buckets)
    return r.withColumn("fold", (F.col("rank") % k).cast("int")).drop("__h", "rank", "stratum_n")


def sample_per_entity(pairs: DataFrame, entity: str, item: str, k: int, seed: int = 42) -> DataFrame:
    """K items per entity in seeded random order: the items of the k smallest
    hashes, cut to k a task and a part before they meet (:func:`bottom_k`), so an
    entity may have any number of items."""
    from panelkit.operators.topk import bottom_k
    order = [F.xxhash64(F.col(entity), F.col(item), F.lit(seed)), F.col(item)]
    return bottom_k(pairs, [entity], order, k, spread=[item], rank="pick")
