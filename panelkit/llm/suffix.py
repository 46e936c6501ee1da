"""Suffix-array dedup: remove every byte covered by a repeated long string, by a
logarithmic family of suffix-array indexes.

Texts are UTF-8 bytes; a string repeats if it also starts anywhere else, the same
document included. A string of ``LENGTH`` bytes is called a window.

* Sampled suffixes. Only suffixes that start at an anchor enter the arrays. An
  anchor is the leftmost smallest hash among ``REACH`` neighbouring 8-byte grams,
  so it depends on the bytes alone: every window has an anchor ``d < REACH`` bytes
  after its start, and an equal window has it at the same ``d``. The
  ``CORE = LENGTH - REACH + 1`` bytes from the anchor on are inside all of these
  windows. A suffix is filed by the digest of its core: the merge scan asks for
  equal cores only, so digest order serves as well as byte order.
* Batches and levels. The input is taken in batches. The suffix array of a batch
  is built (one row per different core, with its count, after map-side
  combination), scanned against each level by a merge join for cores met before,
  and added as a new level; while two levels have the same size class they are
  merged into the next. Levels are tables bucketed and sorted by core, so scans
  and merges of levels move nothing.
* Verification. Anchors with a repeated core fall into classes of equal context
  (all bytes any of its windows can reach). In a class with two members every
  window is repeated. Where classes of one core differ, the contexts of one
  representative each are compared: a window digest per ``d``, sorted inside the
  core's group. Cores with over ``group_rows`` different contexts are compared by
  a shuffle on (core, d, window digest) with map-side counts instead of in one task.
* Text passes. Rows are written once into pages (fixed parts of input splits)
  bucketed by page, so positions are brought to the texts without moving texts.

Defined results: null counts as empty; documents shorter than a window are never
touched; equal rows are separate documents; empty table, empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import drop_shared, page_of, shared_path, sliding, with_row, write_pages, write_shared

LENGTH = 400
REACH = 160
BATCHES = 4
GROUP_ROWS = 16_384
_SEGMENT = 2_000_000
_GRAM = 8


# --- anchors ---------------------------------------------------------------------------------

def anchors(data: bytes, reach: int) -> np.ndarray:
    """Positions that hold the smallest gram hash of some ``reach`` neighbours."""
    grams = len(data) - _GRAM + 1
    if grams < reach:
        return np.empty(0, np.int64)
    h = np.ndarray((grams,), "<u8", buffer=data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = sliding(np.minimum, h, reach, 2 ** 64 - 1)
    # position i is the minimum of one of the windows i-reach+1 .. i if the largest of their minima equals h[i]
    side = np.zeros(reach - 1, np.uint64)
    best = sliding(np.maximum, np.concatenate([side, least, side]), reach, 0)
    return np.flatnonzero(h == best)


def _segments(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Stretches of at most about ``_SEGMENT`` bytes: bytes, and per text part
    (text, offset of the part in the text, offset in the stretch). Long texts
    are cut with an overlap that holds every window."""
    step, lap = _SEGMENT, LENGTH + _GRAM
    parts, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - lap), step):
            piece = t[a: a + step + lap]
            if parts and size + len(piece) > step + lap:
                yield b"".join(p[3] for p in parts), [p[:3] for p in parts]
                parts, size = [], 0
            parts.append((i, a, size, piece))
            size += len(piece)
    if parts:
        yield b"".join(p[3] for p in parts), [p[:3] for p in parts]


def _context(text: bytes, at: int, length: int, reach: int) -> tuple[bytes, int]:
    """All bytes a window with its anchor here can reach, and how many are before it."""
    left = min(at, reach - 1)
    return text[at - left: at + length], left


def suffix_rows(texts: list[bytes], length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all anchors with a whole core: text, position, core digest, context digest."""
    import xxhash

    digest, core = xxhash.xxh64_intdigest, length - reach + 1
    who, where = [], []
    for data, parts in _segments(texts):
        at = anchors(data, reach)
        offsets = np.array([p[2] for p in parts])
        part = np.searchsorted(offsets, at, side="right") - 1
        who.append(np.array([p[0] for p in parts])[part])
        where.append(at - offsets[part] + np.array([p[1] for p in parts])[part])
    if not who:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    both = np.unique(np.stack([np.concatenate(who), np.concatenate(where)], axis=1), axis=0)
    sizes = np.array([len(t) for t in texts])
    both = both[both[:, 1] + core <= sizes[both[:, 0]]]
    n = len(both)
    cores, contexts = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for k, (i, a) in enumerate(both.tolist()):
        text = texts[i]
        cores[k] = digest(text[a: a + core])
        ctx, left = _context(text, a, length, reach)
        contexts[k] = digest(ctx, left + 1)
    return both[:, 0], both[:, 1], cores.view(np.int64), contexts.view(np.int64)


# --- index family ----------------------------------------------------------------------------

class Levels:
    """Geometric levels of suffix arrays ``(core, n)``, as bucketed tables."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.levels = spark, buckets, []

    def _table(self, df: DataFrame) -> str:
        name = f"pk_suffix_{uuid.uuid4().hex}"
        (df.write.format("parquet").option("path", shared_path(self.spark, "suffix-level"))
         .bucketBy(self.buckets, "core").sortBy("core").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        table = self.spark.table(name)
        files = table.inputFiles()
        self.spark.sql(f"DROP TABLE {name}")
        if files:
            drop_shared(self.spark.read.schema(table.schema).parquet(files[0].rsplit("/", 1)[0]))

    def add(self, rows: DataFrame) -> DataFrame:
        """Build the suffix array of a batch, scan it against all levels, keep it;
        returns the cores found repeated."""
        batch = rows.groupBy("core").agg(F.count("*").alias("n"))
        name = self._table(batch.repartition(self.buckets, "core"))
        new = self.spark.table(name)
        found = new.where("n > 1").select("core")
        for _, level in self.levels:  # merge scan: both sides sorted and bucketed by core
            found = found.unionByName(new.join(self.spark.table(level).select("core").hint("merge"), "core").select("core"))
        found = write_shared(found, "suffix-found")
        rank = 0
        while self.levels and self.levels[-1][0] == rank:  # equal sizes merge
            _, other = self.levels.pop()
            a, b = self.spark.table(name).alias("a"), self.spark.table(other).alias("b")
            both = a.join(b.hint("merge"), "core", "full").select(
                "core", (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))
            merged = self._table(both)
            self._drop(name)
            self._drop(other)
            name, rank = merged, rank + 1
        self.levels.append((rank, name))
        return found

    def close(self) -> None:
        for _, name in self.levels:
            self._drop(name)


# --- exact verification ------------------------------------------------------------------------

def window_digests(contexts: list[bytes], lefts: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Per context and d: digest of the window that starts d bytes before the
    anchor (two polynomial residues in one number), and whether it exists."""
    m, width = len(contexts), reach - 1 + length
    table = np.zeros((m, width), np.uint8)
    for i, (c, left) in enumerate(zip(contexts, lefts.tolist())):
        start = reach - 1 - left
        table[i, start: start + len(c)] = np.frombuffer(c, np.uint8)
    cols = np.ascontiguousarray(table.T).astype(np.uint64) + np.uint64(1)
    out = np.zeros((m, reach), np.uint64)
    for prime, base in ((2147483647, 1_000_003), (2147483629, 69_621)):
        p, b = np.uint64(prime), np.uint64(base)
        top = np.uint64(pow(base, length, prime))
        h = np.zeros(m, np.uint64)
        for j in range(length):
            h = (h * b + cols[j]) % p
        for j in range(reach):  # window from column j on: d = reach - 1 - j
            if j:
                h = (h * b + cols[j + length - 1] + (p - cols[j - 1]) * top) % p
            out[:, reach - 1 - j] = (out[:, reach - 1 - j] << np.uint64(31)) ^ h
    rights = np.array([len(c) for c in contexts]) - lefts
    d = np.arange(reach)
    return out, (d <= lefts[:, None]) & (length - d <= rights[:, None])


def repeated_windows(group: np.ndarray, digests: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which (context, d) have an equal window at the same d in the same group."""
    z = digests ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    hit = np.zeros(z.shape, bool)
    for d in range(z.shape[1]):
        rows = np.flatnonzero(valid[:, d])
        if len(rows) < 2:
            continue
        rows = rows[np.argsort(z[rows, d], kind="stable")]
        same = z[rows[1:], d] == z[rows[:-1], d]
        hit[rows[1:][same], d] = True
        hit[rows[:-1][same], d] = True
    return hit


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of True."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, first, end - 1


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, reach: int = REACH,
                 batches: int = BATCHES, group_rows: int = GROUP_ROWS, carry: bool = False) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``
    (removed byte ranges, end excluded) and, with ``carry``, ``row`` and the
    remaining bytes ``kept_text`` (binary: a cut may fall inside a character)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    core = length - reach + 1

    rows = with_row(docs, carry, uid=F.monotonically_increasing_id(), doc_id=F.col(id_col),
                    text=F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    store = write_pages(rows, "suffix-texts")

    # 1. sampled suffixes of every text
    found_schema = "uid long, at int, core long, context long"

    def sample(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, first = [], 0
            size = 0
            for i in range(part.num_rows + 1):
                if i == part.num_rows or size > _SEGMENT:
                    if texts:
                        who, at, cores, contexts = suffix_rows(texts, length, reach)
                        yield pa.RecordBatch.from_arrays(
                            [part["uid"].take(pa.array(who + first)), pa.array(at.astype(np.int32)), pa.array(cores),
                             pa.array(contexts)], names=["uid", "at", "core", "context"])
                    texts, first, size = [], i, 0
                if i < part.num_rows:
                    texts.append(part["text"][i].as_py())
                    size += len(texts[-1])

    suffixes = write_shared(store.select("uid", "text").mapInArrow(sample, found_schema), "suffixes")

    # 2. index family: batches of input parts, merge-scanned against the levels
    levels, found = Levels(spark, buckets), None
    for b in range(batches):
        new = levels.add(suffixes.where(F.expr(f"pmod(shiftright(uid, 33), {batches}) = {b}")).select("core"))
        found = new if found is None else found.unionByName(new)
    levels.close()
    repeated = write_shared(found.distinct(), "suffix-repeated")  # written, so that a hot core's suffixes can be split
    hits = write_shared(suffixes.join(repeated, "core", "left_semi"), "suffix-hits")

    # 3. classes of equal context; the contexts of one of each are compared where classes differ
    classes = write_shared(hits.groupBy("core", "context").agg(
        F.count("*").alias("n"), F.first("uid").alias("uid"), F.first("at").alias("at")), "suffix-classes")
    mixed = write_shared(classes.groupBy("core").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("single"))
                         .where("k > 1 AND single > 0").select("core", "k"), "suffix-mixed")
    asked = classes.join(mixed, "core").select(page_of().alias("page"), "uid", "at", "core", "k", (F.col("n") > 1).alias("full"))
    cut_schema = "core long, uid long, at int, k long, full boolean, left int, bytes binary"

    def cut(texts: pa.Table, at: pa.Table) -> pa.Table:
        where = {u: i for i, u in enumerate(texts["uid"].to_pylist())}
        spot = [where[u] for u in at["uid"].to_pylist()]
        text = texts["text"]
        got = [_context(text[i].as_py(), a, length, reach) for i, a in zip(spot, at["at"].to_pylist())]
        return pa.table({"core": at["core"], "uid": at["uid"], "at": at["at"], "k": at["k"], "full": at["full"],
                         "left": pa.array([g[1] for g in got], pa.int32()), "bytes": pa.array([g[0] for g in got], pa.binary())})

    contexts = write_shared(store.select("page", "uid", "text").groupBy("page").cogroup(asked.groupBy("page"))
                            .applyInArrow(cut, cut_schema), "suffix-contexts")
    run_schema = "uid long, at int, d0 int, d1 int"

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by core; whole cores are compared together."""
        def solve(t: pa.Table) -> pa.RecordBatch:
            ids = np.unique(t["core"].to_numpy(), return_inverse=True)[1]
            digests, valid = window_digests(t["bytes"].to_pylist(), t["left"].to_numpy(), length, reach)
            hit = repeated_windows(ids, digests, valid)
            hit[t["full"].to_numpy(zero_copy_only=False)] = False  # all of theirs are known to be repeated
            row, a, b = _runs(hit)
            t = t.select(["uid", "at"]).take(pa.array(row))
            return pa.RecordBatch.from_arrays([t["uid"].combine_chunks(), t["at"].combine_chunks(), pa.array(a.astype(np.int32)),
                                               pa.array(b.astype(np.int32))], names=["uid", "at", "d0", "d1"])
        rest = None
        for part in parts:
            if not part.num_rows:
                continue
            t = pa.Table.from_batches([part])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < 2048:
                continue
            cores = rest["core"].to_numpy()
            done = int(np.flatnonzero(cores != cores[-1])[-1] + 1) if cores[0] != cores[-1] else 0
            if done:
                yield solve(rest.slice(0, done))
                rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield solve(rest)

    runs = (contexts.where(F.col("k") <= group_rows).select("core", "uid", "at", "full", "left", "bytes")
            .repartition(buckets, "core").sortWithinPartitions("core").mapInArrow(compare, run_schema))

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 2048):
                t = part.slice(a, 2048)
                digests, valid = window_digests(t["bytes"].to_pylist(), t["left"].to_numpy(), length, reach)
                row, d = np.nonzero(valid)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [t["core"].take(take), t["uid"].take(take), t["at"].take(take), t["full"].take(take),
                     pa.array(d.astype(np.int32)), pa.array(digests[row, d].view(np.int64))],
                    names=["core", "uid", "at", "full", "d", "digest"])

    large = contexts.where(F.col("k") > group_rows)
    if not large.isEmpty():
        dense = write_shared(large.select("core", "uid", "at", "full", "left", "bytes").mapInArrow(
            windows, "core long, uid long, at int, full boolean, d int, digest long"), "suffix-dense")
        twice = dense.groupBy("core", "d", "digest").agg(F.count("*").alias("n")).where("n > 1")
        runs = runs.unionByName(dense.where("NOT full").join(twice, ["core", "d", "digest"], "left_semi")
                                .select("uid", "at", F.col("d").alias("d0"), F.col("d").alias("d1")))

    # 4. what is covered, brought to the texts
    whole = hits.join(classes.where("n > 1").select("core", "context"), ["core", "context"], "left_semi").select(
        "uid", "at", F.lit(0).alias("d0"), F.lit(reach - 1).alias("d1"))
    cover = whole.unionByName(runs).withColumn("page", page_of())
    out_schema = T.StructType([f for f in store.schema.fields if f.name in ("doc_id", "row")] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
        + ([T.StructField("kept_text", T.BinaryType())] if carry else []))
    names = [f.name for f in out_schema.fields]

    def remove(texts: pa.Table, at: pa.Table) -> pa.Table:
        order = np.argsort(at["uid"].to_numpy(), kind="stable")
        uids, pos, d0, d1 = (at[c].to_numpy()[order] for c in ("uid", "at", "d0", "d1"))
        cols: dict[str, list] = {n: [] for n in names if n not in ("doc_id", "row")}
        mine = texts["uid"].to_numpy()
        first, last = np.searchsorted(uids, mine, side="left"), np.searchsorted(uids, mine, side="right")
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            text = texts["text"][i].as_py()
            spans = []
            if a < b:
                # windows start d before the anchor, inside the text
                far = np.minimum(d1[a:b], pos[a:b])
                near = np.maximum(d0[a:b], length - (len(text) - pos[a:b]))
                ok = far >= near
                start, end = (pos[a:b] - far)[ok], (pos[a:b] - near + length)[ok]
                by = np.argsort(start, kind="stable")
                start, end = start[by], np.maximum.accumulate(end[by]) if len(by) else end
                cutoff = np.flatnonzero(start[1:] > end[:-1]) + 1 if len(start) else np.empty(0, int)
                begins = start[np.concatenate([[0], cutoff])] if len(start) else start
                ends = end[np.concatenate([cutoff - 1, [len(end) - 1]])] if len(start) else end
                spans = list(zip(begins.tolist(), ends.tolist()))
            kept, at_byte = [], 0
            for s, e in spans:
                kept.append(text[at_byte:s])
                at_byte = e
            kept.append(text[at_byte:])
            rest = b"".join(kept)
            cols["n_bytes"].append(len(text))
            cols["n_removed"].append(len(text) - len(rest))
            cols["n_spans"].append(len(spans))
            cols["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            cols["spans"].append([{"start": s, "end": e} for s, e in spans])
            if carry:
                cols["kept_text"].append(rest)
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
                 "spans": span_type, "kept_text": pa.binary()}
        return pa.table([texts[n] if n in ("doc_id", "row") else pa.array(cols[n], types[n]) for n in names], names=names)

    assert core > _GRAM
    return (store.groupBy("page").cogroup(cover.groupBy("page")).applyInArrow(remove, out_schema))
