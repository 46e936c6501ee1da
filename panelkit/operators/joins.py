"""Joins (J1, J5, J6, J8, J10).

No operator here forces a broadcast of a table whose size grows with the
data: dimension joins are left to Catalyst, which broadcasts only below
``spark.sql.autoBroadcastJoinThreshold`` (a statistics-based size check) and
otherwise plans a sort-merge join that AQE can split on skewed keys.
Explicit ``broadcast`` is used only for tables of fixed, known size (grids,
category orders, the question bank).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["reindex_groups", "broadcast_if_small", "code_lookup", "overlap_count", "grade_answers"]


#: most rows of a dimension that is broadcast
BROADCAST_ROWS = 100_000


def broadcast_if_small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it holds at most ``rows`` rows (counted
    up to the bound only); beyond, the join is left to Catalyst."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def reindex_groups(agg: DataFrame, key: str, order: Sequence[str], drop_incomplete: bool = True) -> DataFrame:
    """Re-index group results to a fixed category order; groups with any
    missing value are dropped (``reindex(...).dropna()``)."""
    spark = agg.sparkSession
    dim = spark.createDataFrame([(v, i) for i, v in enumerate(order)], f"{key} string, __ord int")
    out = F.broadcast(dim).join(agg, key, "left")
    if drop_incomplete:
        out = out.dropna()
    return out.orderBy("__ord").drop("__ord")


def code_lookup(df: DataFrame, codes: DataFrame, col: str, code_col: str = "code",
                missing: int = -1) -> DataFrame:
    """Category → code via a left join to the fitted code table; unseen
    or missing categories get ``missing``. The table has one row per category
    and is broadcast when its row count is small, so the rows themselves are
    not shuffled on a key with few values."""
    return df.join(broadcast_if_small(codes.select(col, code_col)), col, "left").fillna(missing, [code_col])


def overlap_count(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key also appears in ``b`` (0 = no overlap)."""
    return a.join(b.select(*keys), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


def grade_answers(answers: DataFrame, bank: DataFrame) -> DataFrame:
    """Answers (subject, question_id, chosen) ⋈ bank → ``correct``.
    A bank of checked, small size is broadcast; a larger one is joined by
    shuffle."""
    b = broadcast_if_small(bank.select("subject", "question_id", "answer"))
    return answers.join(b, ["subject", "question_id"], "left").withColumn(
        "correct", F.coalesce(F.col("chosen") == F.col("answer"), F.lit(False)))


def lookup_first(df: DataFrame, keys: DataFrame, key: str, row_id: str) -> DataFrame:
    """P16 (batch form): for each requested key, the first matching row by
    ``row_id`` (``df[df.k == x].iloc[0]``). The semi join keeps only
    requested keys before the window, which then sees one key's rows."""
    from pyspark.sql import Window
    hits = df.join(keys.select(key).distinct(), key, "left_semi")
    w = Window.partitionBy(key).orderBy(row_id)
    return hits.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
