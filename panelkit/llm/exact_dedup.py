"""Exact dedup over an extendible-hash index on shared files (SQL functions only).

1. One scan hashes every normalised text (white space deleted) to a 64-bit key
   and writes the rows with their key, digest and length to the shared folder.
2. A directory is grown over the distinct keys: it starts at the depth that the
   number of keys asks for and doubles until no bucket holds more than
   ``bucket_keys`` keys; only buckets that are too full are split again.
3. Owner tasks: the directory's key ranges are dealt to tasks by range. Inside a
   bucket, rows whose keys collide form chains, told apart by comparing the
   bytes of the normalised texts. Only keys that occur more than once get here;
   copies are collapsed on the map side (one row per text and task), so a text
   that fills a third of the table reaches its owner as one row per task.
4. Each row looks its key up in the index; the join is left to adaptive
   execution, which splits a hot key.

Defined results: a null text counts as empty; rows with no words are one group.
Null ids sort last and may be the kept id. Exactly one row of each group is
kept, also when ids or whole rows repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import SPACE, unsigned_prefix, with_row, write_shared


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def grow_directory(keys: DataFrame, bucket_keys: int, key_bits: int) -> DataFrame:
    """Directory ``(depth, prefix, n)`` over distinct ``keys(key)``: buckets are
    the prefixes of ``depth`` bits, none holding over ``bucket_keys`` keys unless
    all ``key_bits`` bits are used up."""
    total = keys.count()
    depth = min(key_bits, max(0, math.ceil(math.log2(max(1, total) / bucket_keys)) if total > bucket_keys else 0))
    active, settled = keys, None
    while True:
        counts = write_shared(active.groupBy(unsigned_prefix(F.col("key"), depth).alias("prefix"))
                              .agg(F.count("*").alias("n")).withColumn("depth", F.lit(depth)), "directory")
        fits = (F.col("n") <= bucket_keys) if depth < key_bits else F.lit(True)
        part = counts.where(fits)
        settled = part if settled is None else settled.unionByName(part)
        over = counts.where(~fits)
        if over.isEmpty():
            return settled
        active = active.join(over.select("prefix"), unsigned_prefix(F.col("key"), depth) == F.col("prefix"), "left_semi")
        depth += 1  # the directory doubles; full buckets split on their next bit


def locate(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """Adds ``bucket_start`` (first key of the bucket, left-aligned) and ``depth``."""
    depths = [r[0] for r in directory.select("depth").distinct().collect()] or [0]  # at most 64 values
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), unsigned_prefix(F.col("key"), d).alias("prefix")) for d in depths])
    return (keys.withColumn("try", F.explode(tries)).select("*", "try.depth", "try.prefix").drop("try")
            .join(directory.select("depth", "prefix"), ["depth", "prefix"], "left_semi"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key_bits: int = 64,
                bucket_keys: int = 4096, carry: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``
    (and ``row`` with ``carry``). Of equal texts the row with most code points,
    then the smallest id, stays. ``key_bits`` below 64 shortens the hash (tests
    use it to force collisions); results do not depend on it."""
    text = F.col("text")
    key = F.shiftleft(unsigned_prefix(F.xxhash64(normalised(text)), key_bits), 64 - key_bits)
    rows = with_row(docs, carry, uid=F.monotonically_increasing_id(), doc_id=F.col(id_col), text=F.col(text_col))
    store = write_shared(rows.withColumns({
        "key": key, "text_sha256": F.sha2(normalised(text), 256),
        "n_chars": F.coalesce(F.length(text), F.lit(0))}), "hash-store")

    # directory over the distinct keys; keys met more than once carry chains
    keys = write_shared(store.groupBy("key").agg(F.count("*").alias("n")), "hash-keys")
    directory = grow_directory(keys.select("key"), bucket_keys, key_bits)
    shared_keys = locate(keys.where("n > 1").select("key"), directory)

    # owner tasks: ranges of buckets; chains are told apart by the bytes of the texts
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id"), F.col("uid"))).alias("best")
    links = (store.select("uid", "doc_id", "key", "n_chars", "text").join(shared_keys.select("key").hint("merge"), "key", "left_semi")
             # grouped by another form of the key: the join then keeps its own partitioning, a hot
             # key is split there, and each part sends one row of each text on
             .groupBy(F.bitwise_not("key").alias("not_key"), normalised(text).alias("norm")).agg(best, F.count("*").alias("group_size")))
    links = write_shared(links.select(F.bitwise_not("not_key").alias("key"), "norm", F.col("best.doc_id").alias("keep_id"),
                                      F.col("best.uid").alias("keep_uid"), "group_size"), "hash-links")
    per_key = links.groupBy("key").agg(
        F.count("*").alias("n_chain"), F.first("keep_id").alias("keep_id"), F.first("keep_uid").alias("keep_uid"),
        F.first("group_size").alias("group_size"))
    index = write_shared(write_shared(per_key, "hash-chains").join(shared_keys, "key")
                         .repartitionByRange(F.expr("shiftleft(prefix, 64 - depth)"), "key"), "hash-index")

    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] + (["row"] if carry else [])
    index = index.select("key", "n_chain", "keep_id", "keep_uid", "group_size")
    need = ["uid", "doc_id", "text_sha256", "key"] + (["row"] if carry else [])
    found = store.select(*need).join(index, "key", "left")
    single = F.col("n_chain").isNull()
    plain = (found.where("n_chain IS NULL OR n_chain = 1")
             .withColumns({"kept": single | (F.col("uid") == F.col("keep_uid")),
                           "keep_id": F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")),
                           "group_size": F.coalesce("group_size", F.lit(1).cast("long"))}).select(*out))
    # keys shared by different texts: the row's own bytes choose its chain
    chained = (store.join(index.where("n_chain > 1").select("key"), "key", "left_semi")
               .withColumn("norm", normalised(text))
               .join(links, ["key", "norm"]).withColumn("kept", F.col("uid") == F.col("keep_uid")).select(*out))
    return plain.unionByName(chained)


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS rn,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""
