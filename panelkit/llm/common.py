"""Helpers shared by the training-data operators: word patterns, tables in the
shared folder, row numbers that survive a retry, and connected components.

Input convention of every operator: ``docs`` may hold any extra columns. The
operators read only the columns they are told to and keep whatever else comes
along inside one struct column ``row``, so no extra column can clash with an
internal one.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import ensure_checkpoint_dir

#: white space and words of the contracts
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder. It is removed
    when the application ends (tables of a finished run are of no use)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _hadoop_fs(spark, path)
    fs.deleteOnExit(p)
    for made in _RECORDS:
        made.append(path)
    return path


_RECORDS: list[list[str]] = []


@contextmanager
def recorded_paths():
    """Collects the shared folders made inside the block."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders whose tables no plan reads any more."""
    for path in paths:
        fs, p = _hadoop_fs(spark, path)
        fs.delete(p, True)


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader.

    Cuts the lineage: a lost executor never replays what came before, and
    values drawn while writing (row numbers) are the same for every reader."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables made by :func:`write_shared` that no plan reads any more."""
    for t in tables:
        for f in t.inputFiles()[:1]:
            fs, p = _hadoop_fs(t.sparkSession, f)
            fs.delete(p.getParent(), True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now. Its cleaner does so
    once the driver's JVM has collected their plans, which else may take until the
    heap is full; tables that are written do not need them any more."""
    spark.sparkContext._jvm.System.gc()


#: parts of an input split that are handled as one group of texts
PAGES = 4


def page_of(uid: str = "uid") -> Column:
    """The page of a row number: its input split, and its place in it modulo PAGES."""
    return F.expr(f"shiftright({uid}, 33) * {PAGES} + {uid} % 8589934592 % {PAGES}")


def write_pages(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a row number ``uid`` written with their ``page``, bucketed by it.
    Every task writes the pages of its own split, so nothing is moved; later,
    small tables are brought to the pages (cogroup by page) instead of moving texts."""
    return write_by_page(rows.withColumn("page", page_of()), name)


def write_by_page(rows: DataFrame, name: str) -> DataFrame:
    """Rows that have a ``page`` written bucketed by it, to be joined with other tables of the pages without a shuffle."""
    spark = rows.sparkSession
    table = f"pk_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (rows.write.format("parquet").option("path", shared_path(spark, name))
     .option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "page").saveAsTable(table))
    return spark.table(table)


def with_row(docs: DataFrame, carry: bool, **cols: Column) -> DataFrame:
    """``cols`` and, with ``carry``, all input columns inside the struct ``row``."""
    out = [c.alias(n) for n, c in cols.items()]
    if carry:
        out.append(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return docs.select(*out)


def unsigned_prefix(key: Column, bits: int) -> Column:
    """The top ``bits`` of a 64-bit key, as a non-negative long for bits < 64."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def sliding(op, x: np.ndarray, width: int, fill: int) -> np.ndarray:
    """``op`` over every ``width`` neighbours of x (block prefixes and suffixes)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1: n])


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)``, root being the
    smallest node reachable; only nodes with an edge are returned.

    Alternating large-star / small-star contraction: each round is two
    map-side-combined ``min`` aggregations and equi-joins, linear in the edges,
    and the number of rounds grows with the logarithm of the longest chain. A
    hub's edges meet in joins of written tables only, which adaptive execution
    splits (a join that shares its partitioning with an aggregation it cannot).
    The driver reads one count per round.
    """
    spark = edges.sparkSession
    cur = write_shared(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is hung on u's smallest neighbour (or u)
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = write_shared(both.groupBy("u").agg(F.min("v").alias("m"))
                             .select(F.col("u").alias("mu"), F.least("u", "m").alias("m")), "least")
        large = (both.where("v > u").join(least, F.col("u") == F.col("mu"))
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        # small star: u's smaller neighbours and u itself are hung on the smallest of them
        large = write_shared(large, "edges")
        low = write_shared(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "mu"), "least")
        hung = large.join(low, F.col("hi") == F.col("mu"))
        nxt = write_shared(
            hung.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
            .unionByName(low.select(F.col("mu").alias("hi"), F.col("m").alias("lo"))).distinct(), "edges")
        # settled when every node hangs on one root that hangs on nothing, i.e. nothing moved
        moved = nxt.join(cur, ["hi", "lo"], "left_anti").limit(1).count() + cur.join(nxt, ["hi", "lo"], "left_anti").limit(1).count()
        drop_shared(cur, least, large, low)
        cur = nxt
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("lo").alias("node")).distinct()
    return (cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .unionByName(roots.withColumn("root", F.col("node"))))
