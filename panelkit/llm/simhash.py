"""SimHash near-dedup with pivot distance tables.

* Fingerprint: majority vote per bit over the 64-bit hashes of all word shingles
  of the whole text, in Arrow batches on the executors.
* Equal fingerprints are one node from then on, so a group of copies is one row.
* Candidates: fingerprints that differ in at most ``max_bits`` bits agree on all
  but ``max_bits`` of ``segments`` bit segments. Each fingerprint is filed under
  the bits of every choice of agreeing segments; only fingerprints of one file
  are compared, and never two that share no file.
* Pivot table: the Hamming distances of every fingerprint to ``PIVOTS``
  reference fingerprints are computed once. By the triangle inequality two
  fingerprints within ``max_bits`` differ by at most ``max_bits`` in each of
  these coordinates; pairs whose largest coordinate difference is above are
  discarded, and the survivors are verified bit by bit.
* Files with more than ``file_rows`` distinct fingerprints are not paired. Their
  members go an exact other way, linear in their number: x and y are within 3
  bits exactly if some z is within 2 of x and within 1 of y. Everything filed
  under a z that has a member within 1 is linked to that member.
* Components by star contraction; the component id is the smallest id in it.

Defined results: a text without words (or null) has fingerprint zero and is
linked like any other; fewer words than a shingle hash as one sequence; null ids
are passed over by the minimum; empty table, empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import connected, with_row, write_shared

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = 6
#: number of reference fingerprints, eight to a packed column
PIVOTS = 16
FILE_ROWS = 64
_BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a whole text, as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), 0
    block: list[int] = []
    for a, b in spans:
        block.append(digest(line[a:b], seed))
        if len(block) == _BLOCK:
            votes, n, block = votes + _count(block), n + len(block), []
    votes, n = votes + (_count(block) if block else 0), n + len(block)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


#: A-Z to a-z, byte by byte
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _count(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: bool) -> DataFrame:
    rows = with_row(docs, carry, doc_id=F.col(id_col), text=F.col(text_col))
    keep = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*keep, T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch[f.name] for f in keep] + [pa.array(fps.view(np.int64))],
                                             names=[f.name for f in schema.fields])

    return rows.mapInArrow(work, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots() -> list[int]:
    """Reference fingerprints, by rule: SHA-256 of their numbers."""
    import hashlib

    return [int.from_bytes(hashlib.sha256(f"pivot {i}".encode()).digest()[:8], "big") for i in range(PIVOTS)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp`` and its distances to all references, eight 7-bit numbers to a long."""
    refs = pivots()
    packed = []
    for first in range(0, PIVOTS, 8):
        col = F.lit(0).cast("long")
        for i, ref in enumerate(refs[first:first + 8]):
            dist = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(ref)))).cast("long")
            col = col.bitwiseOR(F.shiftleft(dist, 7 * i))
        packed.append(col.alias(f"dist{first // 8}"))
    return fps.select("fp", *packed)


def coordinate_gap(a: str, b: str) -> Column:
    """Largest difference between two rows of the pivot table."""
    gaps = []
    for i in range(PIVOTS):
        c, shift = f"dist{i // 8}", 7 * (i % 8)
        gaps.append(F.abs(F.shiftright(F.col(f"{a}.{c}"), shift).bitwiseAND(127)
                          - F.shiftright(F.col(f"{b}.{c}"), shift).bitwiseAND(127)))
    return F.greatest(*gaps)


def segment_masks(segments: int, max_bits: int) -> list[int]:
    """Bits of every choice of ``segments - max_bits`` segments."""
    edges = [64 * i // segments for i in range(segments + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, segments - max_bits)]


def filed(table: DataFrame, segments: int, max_bits: int) -> DataFrame:
    files = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                      for i, m in enumerate(segment_masks(segments, max_bits))])
    return table.select("*", F.explode(files).alias("f")).select(*table.columns, "f.choice", "f.bits")


def _flips(max_flips: int) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for r in range(max_flips + 1) for c in combinations(range(64), r)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that join all pairs within
    ``max_bits`` bits into the same components (small files: the pairs)."""
    table = write_shared(pivot_table(fps), "pivot-table")
    sizes = write_shared(filed(table.select("fp"), segments, max_bits).groupBy("choice", "bits")
                         .agg(F.count("*").alias("n")).where("n > 1"), "fp-files")
    small = write_shared(filed(table, segments, max_bits)
                         .join(sizes.where(F.col("n") <= file_rows), ["choice", "bits"], "left_semi"), "fp-members")
    a, b = small.alias("a"), small.alias("b")
    pairs = (a.join(b, F.expr("a.choice = b.choice AND a.bits = b.bits AND a.fp < b.fp"))
             .where(coordinate_gap("a", "b") <= max_bits)
             .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct())
    big = sizes.where(F.col("n") > file_rows)
    if big.isEmpty():
        return pairs
    hot = write_shared(filed(table.select("fp"), segments, max_bits).join(big, ["choice", "bits"], "left_semi")
                       .select("fp").distinct(), "fp-hot")
    return pairs.unionByName(centre_links(hot, max_bits))


def centre_links(hot: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges from every hot fingerprint to the centres within ``max_bits - max_bits // 2`` bits
    of it: for each z, the least hot fingerprint within ``max_bits // 2`` bits of z."""
    inner = max_bits // 2

    def around(bits: int) -> DataFrame:
        """Every fingerprint within ``bits`` bits of a hot one (a fixed number for each)."""
        return hot.select("fp", F.explode(F.lit(_flips(bits))).alias("flip")).select(
            F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp")

    # Spark takes both sides for as small as the hot fingerprints they are made from (an explode has its input's
    # estimate), and would send one of them to the driver and all executors. The centres are written first, as a
    # join that shares its partitioning with an aggregation cannot split a hot key
    centre = write_shared(around(inner).groupBy("z").agg(F.min("fp").alias("c")), "fp-centres")
    return (around(max_bits - inner).hint("merge").join(centre.hint("merge"), "z")
            .where("fp <> c").select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE_WORDS,
               max_bits: int = MAX_BITS, segments: int = SEGMENTS, file_rows: int = FILE_ROWS,
               carry: bool = False) -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id, kept`` (and ``row``).
    The document whose id is the component's stays; of several rows with that
    id, one."""
    store = fingerprints(docs, id_col, text_col, shingle, carry).withColumn("uid", F.monotonically_increasing_id())
    store = write_shared(store, "simhash-store")
    nodes = write_shared(store.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    comps = connected(links(nodes.select("fp"), max_bits, segments, file_rows))
    groups = write_shared(nodes.join(comps, F.col("fp") == F.col("node"), "left")
                          .select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = write_shared(groups.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    groups = write_shared(groups.join(ids, "root").select("fp", "root", "component_id"), "simhash-groups")
    found = store.select("uid", "doc_id", "fp").join(groups, "fp")
    out = found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    if not carry:
        return out.select("doc_id", "fingerprint", "component_id")
    keeper = write_shared(found.where("doc_id <=> component_id").groupBy("root").agg(F.min("uid").alias("keep_uid")), "simhash-keepers")
    out = out.join(keeper, "root").withColumn("kept", F.col("uid") == F.col("keep_uid"))
    # whole rows move once, to their decisions
    return store.select("uid", "row").join(out, "uid").select("doc_id", "fingerprint", "component_id", "kept", "row")
