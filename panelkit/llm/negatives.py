"""Hard-negative mining: Strassen products of anchor and candidate tiles, then
mergeable heaps of positives and of negatives in a window below each positive.

Method
------
1. Vectors become integers, ``floor(scale * x)``. They are written once, each row
   with a number of its own and dealt by its hash into a strip of candidates;
   anchors are also dealt into strips of anchors. A strip is a tile of about
   ``strip`` rows, so a task's matrices have a fixed size.
2. A group is one anchor tile with one candidate tile. Their inner products are
   one matrix product, computed by Strassen's seven half-size products down to
   ``LEAF``, zero rows and columns filling odd halves up. All sums are int64, so
   scores are exact: the method's intermediate sums may wrap around, but the ring
   of 64-bit integers returns the true score, which step 5 has shown to fit.
3. Positive heaps: the ``n_pos`` best other rows of the anchor's label. Only tiles
   of one label are multiplied here, a label of many rows being cut into many
   tiles, so a hot label is spread like any other.
4. Window heaps: against all candidate tiles, for each of an anchor's positives the
   ``n_neg`` best rows of other labels whose score lies in the window. All of an
   anchor's windows share the one product. A tile yields a heap's best rows only;
   heaps merge by taking the best of both, which Spark does in a ranked window that
   is cut to the heap's size before rows are moved and after.
5. Every anchor meets every candidate, as the contract asks: products grow with
   anchors x rows, and so does nothing else. Tiles move once for each tile they
   meet, 2 x 8 bytes x dimensions for every ``strip`` products; heaps hold 1 row
   in ``strip / n`` products. The driver reads row counts and one norm.

Defined results
---------------
* Rows with a null label, vector or component, or a component that is not finite,
  take no part; nor do rows without an id, as results name rows by it.
* Shorter vectors count as filled up with zeros. An empty vector scores 0.
* Repeated rows are rows of their own, as anchors, positives and negatives; equal
  scores are ordered by id, and rows of one id have one place each.
* Anchors without positives, and positives without negatives in the window, give
  no rows. An empty table gives an empty result.
* Integer vectors so large that a score times 100 might pass 64 bits (by the
  largest norm) are refused with an error, before any product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import write_shared

#: rows of a tile at most and at least; about TILES tiles a table in between
MAX_STRIP, MIN_STRIP, TILES = 4096, 256, 64
#: side from which on a product is not divided further
LEAF = 32
#: rows whose products are held at once inside a group
BLOCK = 1024
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices: seven products of halves instead of eight."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    # zero padding to even sides
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (m | k | n) & 1:
        a, b = np.pad(a, ((0, 2 * hm - m), (0, 2 * hk - k))), np.pad(b, ((0, 2 * hk - k), (0, 2 * hn - n)))
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * hm, 2 * hn), np.int64)
    out[:hm, :hn] = p1 + p4 - p5 + p7
    out[:hm, hn:] = p3 + p5
    out[hm:, :hn] = p2 + p4
    out[hm:, hn:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of every row's k best scores, the first columns on ties;
    scores of ``_NONE`` are none."""
    n = scores.shape[1]
    keep = scores > _NONE
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above = scores > least
        ties = keep & (scores == least)
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (ties & (np.cumsum(ties, axis=1) <= room))
    return np.nonzero(keep)


def matrix_of(tile: pa.Table, width: int) -> np.ndarray:
    """A tile's vectors as rows, filled up with zeros to ``width``."""
    v = tile["v"].combine_chunks()
    if isinstance(v, pa.ChunkedArray):  # a column without chunks stays chunked
        return np.zeros((0, width), np.int64)
    sizes = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(v), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def _column(tile: pa.Table, name: str) -> np.ndarray:
    return tile[name].to_numpy()


def _merged(parts: list[tuple], names: tuple, slots: tuple, k: int) -> list[np.ndarray]:
    """Heaps of blocks merged: the k best rows of every slot."""
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    at = {n: i for i, n in enumerate(names)}
    order = np.lexsort((cols[at["uid"]], cols[at["id"]], -cols[at["score"]], *(cols[at[s]] for s in slots)))
    cols = [c[order] for c in cols]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for s in slots:
        new[1:] |= cols[at[s]][1:] != cols[at[s]][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    keep = np.arange(len(order)) - first < k
    return [c[keep] for c in cols]


def heap_tile(anchors: pa.Table, cands: pa.Table, k: int, low: int | None = None, high: int | None = None, unit: int = 100) -> list[np.ndarray]:
    """The heaps of one anchor tile and one candidate tile. Without a window the k
    best other rows (``anchor, slot, score, id, uid``); with one, per positive the
    k best rows of another label with low * p <= unit * score <= high * p."""
    width = max([1, *(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (anchors, cands) if t.num_rows)])
    a, c = matrix_of(anchors, width), matrix_of(cands, width)
    order = np.lexsort((_column(cands, "uid"), _column(cands, "id")))  # ties go to the first column
    c, ids, uids, labels = c[order], _column(cands, "id")[order], _column(cands, "uid")[order], _column(cands, "label")[order]
    own, own_label = _column(anchors, "uid"), _column(anchors, "label")
    pos = anchors["p"].to_pylist() if low is not None else []
    slots = max(map(len, pos), default=0)
    parts = []
    for x in range(0, len(a), BLOCK):
        mine = own[x: x + BLOCK]
        for y in range(0, len(c), BLOCK):
            cols = slice(y, y + BLOCK)
            s = strassen(a[x: x + BLOCK], np.ascontiguousarray(c[cols].T))
            if low is None:
                s = np.where(mine[:, None] == uids[cols], _NONE, s)
                r, q = best(s, k)
                parts.append((mine[r], np.zeros(len(r), np.int64), s[r, q], ids[cols][q], uids[cols][q]))
                continue
            other = own_label[x: x + BLOCK][:, None] != labels[cols]
            for slot in range(slots):  # one product for all windows of an anchor
                has = np.array([len(v) > slot for v in pos[x: x + BLOCK]], bool)
                p = np.array([v[slot] if len(v) > slot else 0 for v in pos[x: x + BLOCK]], np.int64)
                inside = other & has[:, None] & (unit * s >= low * p[:, None]) & (unit * s <= high * p[:, None])
                r, q = best(np.where(inside, s, _NONE), k)
                parts.append((mine[r], np.full(len(r), slot + 1), s[r, q], ids[cols][q], uids[cols][q]))
    return _merged(parts, ("anchor", "slot", "score", "id", "uid"), ("anchor", "slot"), k)


_HEAP = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "slot", "score", "id", "uid")])


def _heaps(anchors: DataFrame, cands: DataFrame, by: list[str], k: int, **window) -> DataFrame:
    """Heaps of all pairs of tiles with the same ``by``, merged."""
    cands = cands.select(*[F.col(c).alias(c) for c in cands.columns])  # columns of their own beside the anchors'

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = heap_tile(left, right, k, **window) if left.num_rows and right.num_rows else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=_HEAP.names)
    found = anchors.groupBy(*by).cogroup(cands.groupBy(*by)).applyInArrow(tile, _HEAP)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _strip(n: Column, strip: int | None) -> Column:
    """Tiles that n rows are dealt into."""
    size = F.lit(strip) if strip else F.least(F.lit(MAX_STRIP), F.greatest(F.lit(MIN_STRIP), F.ceil(n / TILES)))
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def hard_negatives(rows: DataFrame, anchor: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
                   n_pos: int = 5, n_neg: int = 10, low: int = 30, high: int = 90, scale: int = 256, strip: int | None = None) -> DataFrame:
    """Per anchor and positive its hard negatives, the rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    anchor = F.expr(anchor) if isinstance(anchor, str) else anchor
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    clean = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        anchor.alias("is_anchor"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    wide = F.aggregate(v, F.lit(0.0), lambda s, x: s + (F.lit(float(scale)) * x.cast("double")) ** 2)
    most = rows.where(good).agg(F.max(wide)).first()[0] or 0.0
    if most * 100 * 1.01 + 1 >= 2.0 ** 63:
        raise ValueError("scores of vectors this long do not fit 64 bits: use a smaller scale")
    base = write_shared(clean.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # tiles of each label, and of the whole table; a row's places by the hash of its number
    sizes = base.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("n_a"))
    sizes = write_shared(sizes.select("label", "n", "n_a", _strip(F.col("n"), strip).alias("tiles"), _strip(F.col("n_a"), strip).alias("a_tiles")), "labels")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("n_a").alias("n_a")).select(
        _strip(F.coalesce("n", F.lit(0)), strip).alias("tiles"), _strip(F.coalesce("n_a", F.lit(0)), strip).alias("a_tiles")).first()
    place = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = base.join(sizes, "label")
    anchors = own.where("is_anchor").select("uid", "label", "v", place(F.col("a_tiles"), "a").alias("i"), each(F.col("tiles")).alias("j"))
    cands = own.where("n_a > 0").select("uid", "id", "label", "v", place(F.col("tiles"), "c").alias("j"), each(F.col("a_tiles")).alias("i"))
    positives = write_shared(_heaps(anchors, cands, ["label", "i", "j"], n_pos).select(
        F.col("anchor").alias("uid"), F.col("rank").cast("long").alias("slot"), F.col("score").alias("p"), F.col("id").alias("positive_id")), "positives")
    windows = positives.groupBy("uid").agg(F.expr("transform(sort_array(collect_list(struct(slot, p))), x -> x.p)").alias("p"))
    anchors = base.where("is_anchor").join(windows, "uid").select("uid", "label", "v", "p", place(F.lit(total["a_tiles"]), "a").alias("i"), each(F.lit(total["tiles"])).alias("j"))
    cands = base.select("uid", "id", "label", "v", place(F.lit(total["tiles"]), "c").alias("j"), each(F.lit(total["a_tiles"])).alias("i"))
    window = write_shared(_heaps(anchors, cands, ["i", "j"], n_neg, low=low, high=high), "negatives")
    named = positives.join(base.where("is_anchor").select("uid", F.col("id").alias("anchor_id")), "uid")
    return (window.drop("uid").withColumnsRenamed({"anchor": "u", "slot": "s"}).join(named, (F.col("u") == F.col("uid")) & (F.col("s") == F.col("slot")))
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    F.col("p").alias("positive_score"), F.col("score").alias("negative_score")))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Anchors: ids divisible by 100; where the id is divisible by 7 the label moves on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v, row_number() OVER () AS u
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.u AS au, a.id AS anchor_id, c.u AS cu, c.id AS id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.u <> c.u WHERE a.id % 100 = 0),
p AS (
  SELECT au, anchor_id, cu AS pu, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, id, cu) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.au = s.au AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.au, p.pu ORDER BY s.score DESC, s.id, s.cu)
QUALIFY row_number() OVER w <= 10
"""
