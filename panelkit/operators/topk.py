"""Top-k (T1, T3) over a table and bottom-k per key (W12). A table's top k plans as
TakeOrderedAndProject: each partition keeps k rows, one merge. (T2 sorts and T4 top
categories are in ``aggregates``.)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["top_k", "bottom_k"]

#: parts that the rows of a key are dealt to; results do not depend on it
PARTS = 32


def top_k(df: DataFrame, score: str, k: int, tiebreak: str, ascending: bool = False) -> DataFrame:
    """K rows by score; ties keep the lowest ``tiebreak``."""
    o = F.asc(score) if ascending else F.desc(score)
    return df.orderBy(o, F.asc(tiebreak)).limit(k)


def bottom_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str],
             parts: int | None = None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key by ``order``, numbered from 1.

    Every task cuts its rows to k a key before they are shuffled (the rank limit that
    Spark puts below the exchange), a key's rows meet in ``parts`` parts dealt by a hash
    of the ``spread`` columns, and only the parts' k rows meet by key. So a key with a
    third of all rows is in no single task. The result is its own mergeable state:
    bottom-k of the union of results is the bottom-k of the union of the rows.

    ``order`` must end in a unique column for the choice among ties to be stated; rows
    equal in all of it are interchangeable. Missing keys are a key; missing values of
    ``order`` come where the order puts them (first, ascending)."""
    n = parts or PARTS
    part = F.pmod(F.xxhash64(*spread), F.lit(n))
    if n > 1:
        w = Window.partitionBy(*keys, "__part").orderBy(*order)
        df = df.withColumn("__part", part).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__part", "__r")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
