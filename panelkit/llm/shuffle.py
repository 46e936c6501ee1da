"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows are written once with the number of their input part. Shard sizes are
   fixed up front (row counts at most one apart) and every shard is cut into
   blocks of slots, at most ``block_rows`` rows each.
2. How many rows part p sends to block b of a uniform random permutation follows
   a multivariate hypergeometric law given the blocks' free slots; the matrix is
   drawn exactly, part after part. The driver holds counts only (parts x blocks).
3. Each part permutes its rows locally and deals them out by its matrix row;
   the rows are exchanged; each block permutes what it got. Slot = start of the
   block + place inside it, so slots are gapless and every permutation of the
   table is equally likely.

Parts are input splits and blocks hold at most ``block_rows`` rows, so no task
grows with the data, and no key, source or group of copies decides where a row
goes. All draws are seeded by (seed, part) and (seed, block), so a task that
runs again gives the same rows.

Defined results: nulls, repeated rows and any extra columns are just rows; an
empty table gives an empty result; fewer rows than shards leaves shards empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import with_row, write_shared

#: numpy draws hypergeometric numbers for populations below this
_NUMPY_MAX = 10 ** 9


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """Rows of ``good`` among ``n`` drawn without replacement from good + bad."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _NUMPY_MAX:
        return int(rng.hypergeometric(good, bad, n))
    # inversion over the support within 40 standard deviations of the mean (what lies beyond is below 1e-300)
    total = good + bad
    mean = n * (good / total)
    sd = math.sqrt(max(1.0, mean * (bad / total) * ((total - n) / (total - 1))))
    lo = max(0, n - bad, math.floor(mean - 40 * sd))
    hi = min(n, good, math.ceil(mean + 40 * sd))
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logp - logp.max())
    return int(lo + np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))


def communication_matrix(part_rows: list[int], block_rows: list[int], seed: int) -> np.ndarray:
    """Counts of rows from part p to block b; rows and columns sum to the inputs."""
    free = np.array(block_rows, dtype=np.int64)
    out = np.zeros((len(part_rows), len(free)), dtype=np.int64)
    for p, n in enumerate(part_rows):
        rng = np.random.default_rng([seed, 1, p])
        left, total = int(n), int(free.sum())
        for b in np.flatnonzero(free):
            if not left:
                break
            got = _hypergeometric(rng, int(free[b]), total - int(free[b]), left)
            total -= int(free[b])
            left -= got
            out[p, b] = got
        free -= out[p]
    return out


def hypergeometric_shuffle(df: DataFrame, shards: int = 40, *, seed: int = 11, block_rows: int = 1_000_000,
                           max_parts: int = 4096) -> DataFrame:
    """All columns of ``df`` inside ``row``, and ``shard int, slot long``.

    At most ``max_parts`` parts enter the matrix; beyond, input splits are
    joined into one part round robin."""
    spark = df.sparkSession
    rows = write_shared(with_row(df, True, part=F.pmod(F.spark_partition_id(), F.lit(max_parts)),
                                 uid=F.monotonically_increasing_id()), "shuffle-rows")
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("uid", T.LongType()), rows.schema["row"]])
    out_schema = T.StructType([rows.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    if not total:
        return spark.createDataFrame([], out_schema)

    blocks = []  # (shard, first slot, rows)
    for s in range(shards):
        size = total // shards + (s < total % shards)
        pieces = max(1, math.ceil(size / block_rows))
        edges = [size * i // pieces for i in range(pieces + 1)]
        blocks += [(s, a, b - a) for a, b in zip(edges, edges[1:])]
    matrix = communication_matrix([n for _, n in counts], [b[2] for b in blocks], seed)
    plan = spark.createDataFrame([(p, m.tolist()) for (p, _), m in zip(counts, matrix)], "part int, counts array<long>")
    table = spark.sparkContext.broadcast([(s, a) for s, a, _ in blocks])  # blocks: one pair per block_rows rows

    def deal(part: pa.Table, row: pa.Table) -> pa.Table:
        """Permute a part and cut it by its row of the matrix."""
        key = part["part"][0].as_py()
        take = np.argsort(part["uid"].to_numpy(), kind="stable")
        take = take[np.random.default_rng([seed, 2, key]).permutation(len(take))]
        to = np.repeat(np.arange(len(table.value), dtype=np.int32), row["counts"][0].as_py())
        part = part.take(pa.array(take))
        return pa.table({"block": pa.array(to), "uid": part["uid"], "row": part["row"]})

    def settle(block: pa.Table) -> pa.Table:
        """Permute a block; its rows take the block's slots in that order."""
        key = block["block"][0].as_py()
        shard, first = table.value[key]
        take = np.argsort(block["uid"].to_numpy(), kind="stable")
        take = take[np.random.default_rng([seed, 3, key]).permutation(len(take))]
        n = len(take)
        return pa.table({"row": block["row"].take(pa.array(take)), "shard": pa.array(np.full(n, shard, np.int32)),
                         "slot": pa.array(np.arange(first, first + n, dtype=np.int64))})

    dealt = rows.groupBy("part").cogroup(plan.groupBy("part")).applyInArrow(deal, schema)
    return dealt.groupBy("block").applyInArrow(settle, out_schema)


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """Per document: size (UTF-8 bytes + 16), checksum, shard and slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return (hypergeometric_shuffle(cols, shards)
            .select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
