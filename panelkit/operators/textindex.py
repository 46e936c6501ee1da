"""Substring search with a trigram index.

Every position of a text begins a gram of three letters, upper-cased (two end marks are
appended, so the last letters begin one too). The postings (gram, id), sorted by gram
into files, and the number of texts a gram stands in are stored once. A search takes the
rarest grams of the pattern, reads their postings only (the gram is a pushed-down filter
on sorted files), keeps the ids that have them all and verifies these texts with
``contains``. A pattern of one or two letters reads the grams that begin with it.

Results equal the scan ``contains(upper(text), upper(pattern))`` for every pattern:
missing texts match nothing, the empty pattern matches every other text. Ids are those
of rows: a repeated id matches if one of its texts has the grams, and each of its rows
is verified by itself; a missing id is not indexed, so rows without id are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["build_index", "search", "candidates"]

#: appended to a text; no letter of a pattern equals it
END = "\u0000"
GRAM = 3
#: grams of a pattern that are looked up; any number gives the same result
RAREST = 4
#: letters of texts (so at most as many postings) that a file of the index is made for
FILE_LETTERS = 1_000_000


def _grams(text: Column) -> Column:
    t = F.concat(F.upper(text), F.lit(END * (GRAM - 1)))
    at = F.sequence(F.lit(1), F.length(t) - F.lit(GRAM - 1))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(at, lambda i: F.substring(t, i, F.lit(GRAM)))))


def build_index(df: DataFrame, id_col: str, text: str, path: str, files: int | None = None) -> None:
    """Write the postings and the gram counts below ``path``. Files are ranges of
    (gram, id), so a gram that every text has fills several of them."""
    spark = df.sparkSession
    texts = df.where(F.col(id_col).isNotNull())
    n = files
    if not n:  # a file, and the task that sorts it, does not grow with the table
        letters = texts.agg(F.sum(F.length(text))).first()[0] or 0  # one number
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-letters // FILE_LETTERS))
    rows = texts.select(F.explode(_grams(F.col(text))).alias("gram"), F.col(id_col).alias("id"))
    # equal postings meet in one range
    rows = rows.repartitionByRange(n, "gram", "id").distinct()
    rows.sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange(max(1, n // 8), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """Ids whose texts have the looked-up grams of ``pattern`` (all that contain it are
    among them); None if every text must be taken."""
    p = spark.range(1).select(F.upper(F.lit(pattern)).alias("p")).first()[0]  # the letters that the index holds
    if not p or END in p:
        return None
    postings = spark.read.parquet(f"{path}/postings")
    if len(p) < GRAM:
        return postings.where(F.col("gram").startswith(p)).select("id").distinct()
    grams = sorted({p[i:i + GRAM] for i in range(len(p) - GRAM + 1)})
    known = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(grams)).collect()}  # a number per gram
    if len(known) < len(grams):  # a gram that no text has
        return postings.where(F.lit(False)).select("id")
    rarest = sorted(grams, key=lambda g: (known[g], g))[:RAREST]
    hits = postings.where(F.col("gram").isin(rarest))
    if len(rarest) == 1:
        return hits.select("id")
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("id")


def search(df: DataFrame, id_col: str, text: str, path: str, pattern: str) -> DataFrame:
    """Rows of ``df`` (the indexed table) whose text contains ``pattern`` in any case."""
    found = F.coalesce(F.contains(F.upper(F.col(text)), F.upper(F.lit(pattern))), F.lit(False))
    ids = candidates(df.sparkSession, path, pattern)
    if ids is None:
        return df.where(found)
    hit = df.join(ids.select(F.col("id").alias("__id")), F.col(id_col) == F.col("__id"), "left_semi").where(found)
    return hit.unionByName(df.where(F.col(id_col).isNull() & found))
