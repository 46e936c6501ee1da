"""A latest-state table per entity, kept up by changes.

The table holds one row per entity with its history, an array of (order, values) in
order, from which the latest and previous values are read. It is stored in hash buckets
of the entity. A batch of changes rewrites only the buckets of its entities: their old
rows are read, merged and written as a new generation; a small table names the
generation in which each bucket was last written. Files are never changed in place: a
batch that fails is not named and not read, may be run again, and readers of the old
generations are not disturbed (they stay until their folder is dropped).

Defined results: rows of one entity and order value replace each other, a later batch
an earlier one; within a batch the greatest values (compared column by column, missing
ones first) stay. Rows without entity or order value hold no state and are left out.
A history is as long as an entity has distinct order values (years).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

__all__ = ["upsert", "read_state", "latest", "generations"]


def _named(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/named")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("bucket int, generation int").parquet(f"{path}/named")


def generations(spark: SparkSession, path: str) -> dict[int, int]:
    """Bucket -> the generation that holds it (as many numbers as buckets)."""
    named = _named(spark, path)
    return {} if named is None else dict(map(tuple, named.groupBy("bucket").agg(F.max("generation")).collect()))


def _buckets(spark: SparkSession, path: str, which: dict[int, int]) -> DataFrame | None:
    """Only the folders of these buckets are listed and read."""
    folders = [f"{path}/rows/generation={g}/bucket={b}" for b, g in sorted(which.items())]
    return spark.read.option("basePath", f"{path}/rows").parquet(*folders) if folders else None


def _histories(rows: DataFrame, entity: str, order: str, values: Sequence[str]) -> DataFrame:
    """Entity and its history; equal (entity, order) rows are combined map-side."""
    one = rows.where(F.col(entity).isNotNull() & F.col(order).isNotNull()).groupBy(entity, order).agg(F.max(F.struct(*values)).alias("v"))
    return one.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(f"v.{c}").alias(c) for c in values]))).alias("history"))


def upsert(spark: SparkSession, path: str, changes: DataFrame, entity: str, order: str, values: Sequence[str], buckets: int) -> list[int]:
    """Merge ``changes`` into the table at ``path`` (made by the first call) and return
    the buckets that were rewritten. ``buckets`` must be the same for all calls: about
    one for every 100 MB of the table."""
    new = _histories(changes, entity, order, values).withColumn("bucket", F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int"))
    new = cut_lineage(new)  # the batch is read once, also where its rows would differ when read again
    at = generations(spark, path)
    if any(b >= buckets for b in at):
        raise ValueError(f"the table at {path} has more than {buckets} buckets")
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    if not touched:
        return []
    old = _buckets(spark, path, {b: at[b] for b in touched if b in at})
    if old is not None:
        both = old.select(entity, "bucket", F.col("history").alias("__old")).join(
            new.withColumnRenamed("history", "__new"), [entity, "bucket"], "full")
        empty = F.array().cast(new.schema["history"].dataType)
        fresh = F.coalesce("__new", empty)
        kept = F.filter(F.coalesce("__old", empty), lambda h: ~F.array_contains(F.transform(fresh, lambda n: n[order]), h[order]))
        new = both.select(entity, "bucket", F.array_sort(F.concat(kept, fresh)).alias("history"))
    last = None if (named := _named(spark, path)) is None else named.agg(F.max("generation")).first()[0]
    generation = 0 if last is None else last + 1
    # overwrite: a failed attempt at this generation is not named and goes
    (new.repartition(min(len(touched), buckets), "bucket").sortWithinPartitions("bucket", entity)
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/generation={generation}"))
    (spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in touched])).alias("bucket"), F.lit(generation).alias("generation"))
     .coalesce(1).write.mode("append").parquet(f"{path}/named"))
    return touched


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Entity and history, one row per entity."""
    out = _buckets(spark, path, generations(spark, path))
    if out is None:
        raise ValueError(f"no state at {path}")
    return out.drop("generation", "bucket")


def latest(state: DataFrame, entity: str, order: str, values: Sequence[str]) -> DataFrame:
    """Per entity: the last row's order and values, the previous row's as ``prev_*``,
    and the number of rows. Read from the row alone: no shuffle."""
    h = F.col("history")
    at = lambda i, c: F.try_element_at(h, F.lit(i))[c]
    return state.select(entity, at(-1, order).alias(order), *[at(-1, c).alias(c) for c in values], at(-2, order).alias(f"prev_{order}"),
                        *[at(-2, c).alias(f"prev_{c}") for c in values], F.size(h).alias("n_rows"))
