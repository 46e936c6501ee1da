"""Tree ensembles grown from histograms (ML5–ML10): multinomial boosting and
forests whose bags follow the row.

Why not MLlib's: its boosting is binary only (one-vs-rest has no probabilities
and did not end on the reference's settings), and its samples are drawn per
partition, so a model depends on how rows are laid out.

How
---
1. Features are cut once, at exact quantiles found by distributed selection
   (:mod:`panelkit.operators.quantiles`), into at most ``max_bins`` bins and one for
   missing values. Rows are packed, ``CHUNK_ROWS`` at a time, into small integer
   arrays. They are the one place where the panel part leaves the JVM: a round
   needs hundreds of sums per row, for which arrays are the natural form. A task
   works on one chunk and one tree at a time, so what it holds depends neither on
   the rows nor on how many trees grow at once.
2. A level of all trees that grow at the same time (all classes, all folds of a
   cross-validation, or a batch of a forest's trees) is one job. Every partition
   sums count, gradient and curvature (forests: class weights) per (tree, node,
   feature, bin); the sums are added up in a tree of reduces, and the driver sees
   their total, whose size does not depend on the rows, and picks the splits.
3. Sums are integers (2^-24 units), so they do not depend on the order of
   rows, partitions or reduces. Subsamples and Poisson bag weights come from a hash
   of (row key, round or tree). The same rows give the same trees in any layout.
4. No level of a round needs an earlier round's work again: a round's steps are
   added to the scores, which are kept with the packed rows. Every ``CHECKPOINT``
   rounds these are checkpointed to the shared folder, so a lost executor costs
   its partitions the rounds since.
5. Up to ``ONE_TASK_ROWS`` rows there is one partition and nothing to add up: each
   fit (or batch of trees) is then a task that grows its levels with the same
   functions. Sums being exact, both ways give the same trees.

Fits may be bounded to ``max_rows`` rows of lowest key hash (a documented bound of
a fit on labelled rows; 0 is none). Scoring is one pass over all rows, in place.

Defined results: rows without a label are not learned from; a missing feature is a
bin of its own, right of every cut; ties between splits go to the smaller feature,
then the smaller cut; a node without a gain is a leaf. One class gives probability 1.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.quantiles import column_quantiles
from panelkit.session import drop_stores, ensure_checkpoint_dir

__all__ = ["fit_boosting", "fit_forest", "HistogramTreesModel", "bag_weight", "in_subsample"]

# functions that run in Python workers travel with the job, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: units of a sum
UNIT = 1 << 24
#: rounds after which the packed rows and their scores are checkpointed
CHECKPOINT = 25
#: rows of a packed partition and, at least, of a full chunk in it; bytes of a forest level's sums
BLOCK_ROWS, CHUNK_ROWS, LEVEL_BYTES = 200_000, 30_000, 8 << 20
#: bytes of partial sums that the driver may add up by itself
DRIVER_BYTES = 64 << 20
#: rows up to which one task grows a fit, or a batch of trees, by itself
ONE_TASK_ROWS = 100_000

# fixed values: distribution function of Poisson(1) in units of 2^-32; draws beyond the last entry are 9
POISSON = [int(sum(1 / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(n + 1)) / np.e * 2 ** 32) for n in range(9)]


def _draws(keys: np.ndarray, seed: int, number: int) -> np.ndarray:
    """32 uniform bits of every key for the given seed and number."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) % 2 ** 64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def bag_weight(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Poisson(1) weights of rows in a tree's bag, from the rows' keys alone."""
    draw, out = _draws(keys, seed, tree), np.zeros(len(keys), np.int64)
    for p in POISSON:
        out += draw >= np.uint64(p)
    return out


def in_subsample(keys: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    return _draws(keys, seed, round_) < np.uint64(int(share * 2 ** 32))


def cut_points(rows: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Per feature the values at exact quantiles; a value x lies in the bin numbered
    by the cuts below it, and a cut's bin goes left."""
    levels = [i / max_bins for i in range(1, max_bins)]
    got = {r["column"]: r["quantiles"] for r in column_quantiles(rows, features, levels, how="lower").collect()}
    return [sorted({v for v in got.get(c, []) if v is not None}) for c in features]


def binned(x: np.ndarray, cuts: list[list[float]], bins: int) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), bins - 1, np.searchsorted(np.array(c), x[:, j], "left"))
    return out


def nodes_of(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of rows in one tree: a heap of nodes, where a feature of -1 is a leaf. ``flat``
    are the bins row by row and ``base`` is where a row begins."""
    at, split = np.arange(len(feature)), np.maximum(feature, 0).astype(np.intp)
    child = np.where(feature[:, None] < 0, at[:, None], 2 * at[:, None] + [1, 2]).ravel()
    node = np.zeros(len(base), np.intp)
    for _ in range(levels):
        right = flat.take(base + split.take(node)) > cut.take(node)
        node = child.take(2 * node + right)
    return node


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row in every tree (trees x rows)."""
    flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    out = np.zeros((len(feature), len(x)), np.intp)
    for t, (f, c) in enumerate(zip(feature, cut)):
        if t and np.array_equal(f, feature[t - 1]) and np.array_equal(c, cut[t - 1]):
            out[t] = out[t - 1]  # two classes share their trees
        else:
            out[t] = nodes_of(flat, base, f, c, levels)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def spark_slots(rows: DataFrame) -> int:
    return max(2, rows.sparkSession.sparkContext.defaultParallelism)


def _packed(rows: DataFrame, features: Sequence[str], cuts: list[list[float]], bins: int, key: Column, label: Column, weight: Column,
            fold: Column, max_rows: int, one_task_rows: int, block_rows: int):
    """An RDD of dicts of arrays, one for every chunk of rows, and the number of rows."""
    rows = rows.select(key.cast("long").alias("key"), label.cast("int").alias("y"), weight.cast("double").alias("w"),
                       fold.cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    rows = rows.where("y IS NOT NULL")
    n = rows.count()
    if max_rows and n > max_rows:  # the lowest key hashes: the limit's exact rank is bounded by max_rows
        rows, n = rows.orderBy("key").limit(max_rows), max_rows
    schema = T.StructType([T.StructField(c, T.BinaryType()) for c in ("key", "y", "w", "fold", "x")])
    width = len(features)

    def record(held):
        t = pa.Table.from_batches(held)
        x = np.stack([t[f"x{i}"].to_numpy() for i in range(width)], 1).astype(float) if width else np.zeros((t.num_rows, 0))
        cols = [t["key"].to_numpy().view(np.uint64), t["y"].to_numpy().astype(np.int32), t["w"].to_numpy().astype(float),
                t["fold"].to_numpy().astype(np.int32), binned(x, cuts, bins)]
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols], names=schema.names)

    def pack(batches):
        held, rows_held = [], 0
        for batch in batches:
            for b in (batch.slice(i, CHUNK_ROWS) for i in range(0, batch.num_rows, CHUNK_ROWS)):
                held.append(b)
                rows_held += b.num_rows
                if rows_held >= CHUNK_ROWS:
                    yield record(held)
                    held, rows_held = [], 0
        if held:
            yield record(held)

    def block(r):
        key = np.frombuffer(bytes(r["key"]), np.uint64)
        return {"key": key, "y": np.frombuffer(bytes(r["y"]), np.int32), "w": np.frombuffer(bytes(r["w"])),
                "fold": np.frombuffer(bytes(r["fold"]), np.int32), "x": np.frombuffer(bytes(r["x"]), np.uint8).reshape(len(key), width)}
    slots = spark_slots(rows)
    # as many for every slot, or an odd number of the given size: another layout than the first
    parts = -(-n // block_rows) | 1 if block_rows else -(-n // (BLOCK_ROWS * slots)) * slots
    parts = 1 if n <= one_task_rows else max(2, parts if block_rows else min(n // 4_000, parts))
    return rows.repartition(parts, "key").mapInArrow(pack, schema).rdd.map(block), n


def _total(rdd, f, size: int = 0):
    """The sum of one array (of ``size`` bytes) of every chunk."""
    def part(chunks):
        total = None
        for b in chunks:
            s = f(b)
            total = s if total is None else np.add(total, s, out=total)
        return [] if total is None else [total]
    parts, many = rdd.mapPartitions(part), rdd.getNumPartitions()
    return parts.treeReduce(np.add, 2) if many > 16 and many * size > DRIVER_BYTES else parts.reduce(np.add)


def _in_fit(fold: np.ndarray, fits: Sequence[int | None]) -> np.ndarray:
    """fits x rows: a fit of None learns from all rows, one of k from those outside fold k."""
    return np.stack([np.ones(len(fold), bool) if k is None else fold != k for k in fits])


def _boosting_sums(x: np.ndarray, use: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, bins: int, stats: list[np.ndarray]) -> np.ndarray:
    """(tree, node of the level, feature, bin, stat): count and integer sums of ``stats``
    (trees x rows) over a chunk's rows that each tree uses and that stand in a node of the level."""
    first, width, features = 2 ** level - 1, 2 ** level, x.shape[1]
    flat, columns, size = np.ascontiguousarray(x).ravel(), np.ascontiguousarray(x.T), 2 ** level * bins
    out = np.empty((len(feature), features, 1 + len(stats), size), np.int64)
    for t in range(len(feature)):
        r = np.flatnonzero(use[t])
        n = nodes_of(flat, r * features, feature[t], cut[t], level) - first
        r, n = r[n >= 0], n[n >= 0]
        at, weights = n * bins, [s[t].take(r) for s in stats]
        for j in range(features):
            place = at + columns[j].take(r)
            out[t, j, 0] = np.bincount(place, minlength=size)
            for k, w in enumerate(weights, 1):
                out[t, j, k] = np.bincount(place, w, size)  # integers below 2^53 are exact
    return np.ascontiguousarray(out.reshape(len(feature), features, 1 + len(stats), width, bins).transpose(0, 3, 1, 4, 2))


def fit_boosting(rows: DataFrame, features: Sequence[str], label: str, classes: int, *, key: Sequence[str], rounds: int, depth: int, rate: float,
                 subsample: float = 1.0, seed: int = 42, max_bins: int = 32, fold: str | None = None, fits: Sequence[int | None] = (None,),
                 max_rows: int = 0, one_task_rows: int = ONE_TASK_ROWS, block_rows: int = 0) -> list["HistogramTreesModel"]:
    """Multinomial boosting: a round fits a tree to the gradient of each class's log
    loss, a leaf steps by (K - 1) / K * sum(gradient) / sum(p (1 - p)). All ``fits``
    (the whole, or without one fold) grow in the same jobs. ``label`` numbers classes from 0."""
    spark, features = rows.sparkSession, list(features)
    ensure_checkpoint_dir(spark)
    cuts = cut_points(rows.where(F.col(label).isNotNull()), features, max_bins)
    bins = max(map(len, cuts), default=0) + 2
    blocks, n = _packed(rows, features, cuts, bins, F.xxhash64(*key), F.col(label), F.lit(1.0), F.col(fold) if fold else F.lit(-1), max_rows, one_task_rows, block_rows)
    size, step = 2 ** (depth + 1) - 1, rate * (classes - 1) / classes
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    prior = np.zeros((len(fits), classes), np.int64)
    if n:
        prior = _total(blocks, lambda b: np.stack([np.bincount(b["y"][m], minlength=classes) for m in _in_fit(b["fold"], fits)]))
    start = np.log(np.maximum(prior, 1e-9) / np.maximum(prior.sum(1, keepdims=True), 1))
    rounds = rounds if n and classes > 1 else 0

    # of two classes one has the other's trees with opposite values
    grown_classes = [1] if classes == 2 else list(range(classes))
    per = len(grown_classes)

    def gradients(b, z, own, r):
        """Of every tree (fit, class) of the fits ``own`` in round r: gradient and
        curvature of each row, and whether the row takes part."""
        p = softmax(z)[..., grown_classes]
        g = np.round(((b["y"][:, None] == np.array(grown_classes)) - p) * UNIT).transpose(0, 2, 1).reshape(-1, len(b["y"]))
        h = np.round(p * (1 - p) * UNIT).transpose(0, 2, 1).reshape(-1, len(b["y"]))
        return g, h, np.repeat(_in_fit(b["fold"], own) & in_subsample(b["key"], seed, r, subsample), per, 0)

    def sums(b, g, h, use, feature, cut, level):
        return _boosting_sums(b["x"], use, feature, cut, level, bins, [g, h])

    def step_of(b, tree, count):
        """What a round adds to the scores of ``count`` fits."""
        node = walk(b["x"], tree[0], tree[1], depth)
        add = np.take_along_axis(tree[2], node, 1).reshape(count, per, -1).transpose(0, 2, 1)
        return np.concatenate([-add, add], -1) if per < classes else add

    def no_trees(count):
        return np.full((count * per, size), -1, np.int16), np.zeros((count * per, size), np.int16), np.zeros((count * per, size))
    def scores(b, count=len(fits), at=0):
        return b["z"] if "z" in b else np.repeat(start[at: at + count, None, :], len(b["y"]), 1)
    if n <= one_task_rows:
        def whole(items):
            chunks = {}
            for i, b in items:
                chunks.setdefault(i, []).append({**b, "z": scores(b, 1, i)})
            for i, own in chunks.items():
                made = []
                for r in range(rounds):
                    tree, stats = no_trees(1), [gradients(b, b["z"], fits[i: i + 1], r) for b in own]
                    for level in range(depth):
                        _grow_boosting(sum(sums(b, *s, *tree[:2], level) for b, s in zip(own, stats)), *tree, 2 ** level - 1, level == depth - 1, step)
                    for b in own:
                        b["z"] = b["z"] + step_of(b, tree, 1)
                    made.append(tree)
                yield i, made
        each = blocks.flatMap(lambda b: [(i, b) for i in range(len(fits))]).partitionBy(len(fits), int).mapPartitions(whole)
        grown = {i: [tuple(t.copy() for t in tree) for tree in made] for i, made in each.collect()}
        grown = [grown.get(i, []) for i in range(len(fits))]
    else:
        all_trees, old, kept = [], None, []
        for r in range(rounds):
            tree = no_trees(len(fits))
            for level in range(depth):
                s = _total(blocks, lambda b, f=tree[0].copy(), c=tree[1].copy(), level=level, r=r: sums(
                    b, *gradients(b, scores(b), fits, r), f, c, level), len(tree[0]) * 2 ** level * len(features) * bins * 24)
                if old is not None:  # the level's job has stored this round's scores
                    old.unpersist()
                    old = None
                    new = blocks.getCheckpointFile()
                    if new and new not in kept:  # what was stored before is not read any more
                        drop_stores(spark, kept)
                        kept = [new]
                _grow_boosting(s, *tree, 2 ** level - 1, level == depth - 1, step)
            all_trees.append(tree)
            if r + 1 < rounds:
                old, blocks = blocks, blocks.map(lambda b, tree=tree: {**b, "z": scores(b) + step_of(b, tree, len(fits))})
                blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
                if (r + 1) % CHECKPOINT == 0:
                    blocks.checkpoint()
        drop_stores(spark, kept)
        grown = [[tuple(a[i * per: (i + 1) * per] for a in tree) for tree in all_trees] for i in range(len(fits))]
    blocks.unpersist()
    if per < classes:
        grown = [[(np.repeat(f, 2, 0), np.repeat(c, 2, 0), np.concatenate([-v, v])) for f, c, v in made] for made in grown]
    stack = lambda made, j: np.stack([t[j] for t in made]) if made else np.zeros((0, classes, size))
    return [HistogramTreesModel.of(kind="boosting", features=features, cuts=cuts, bins=bins, depth=depth, start=start[i], feature=stack(made, 0),
                                   cut=stack(made, 1), value=stack(made, 2)) for i, made in enumerate(grown)]


def _grow_boosting(s: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, first: int, last: bool, step: float) -> None:
    """Split the nodes of a level by the largest drop of squared error, and give
    values to the leaves that are known now."""
    trees, width = s.shape[:2]
    left = s.cumsum(3)
    whole = left[:, :, :1, -1:, :]  # the same for every feature
    right = whole - left
    fl, fr, fw = left.astype(float), right.astype(float), whole.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = fl[..., 1] ** 2 / fl[..., 0] + fr[..., 1] ** 2 / fr[..., 0] - fw[..., 1] ** 2 / fw[..., 0]
    gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), gain, -1.0).reshape(trees, width, -1)
    best = gain.argmax(-1)
    ok = np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-9 * UNIT * UNIT

    def leaf(x):
        return step * x[..., 1] / x[..., 2] if x[..., 2] > 0 else 0.0
    bins = s.shape[3]
    for t, n in zip(*np.nonzero(whole[:, :, 0, 0, 0] > 0)):
        node = first + n
        if not ok[t, n]:
            value[t, node] = leaf(whole[t, n, 0, 0])
            continue
        f, c = divmod(int(best[t, n]), bins)
        feature[t, node], cut[t, node] = f, c
        if last:
            value[t, 2 * node + 1], value[t, 2 * node + 2] = leaf(left[t, n, f, c]), leaf(right[t, n, f, c])


def fit_forest(rows: DataFrame, features: Sequence[str], label: str, classes: int, *, key: Sequence[str], trees: int, depth: int, min_leaf: int = 1,
               weight: str | None = None, seed: int = 42, max_bins: int = 32, fold: str | None = None, fits: Sequence[int | None] = (None,),
               max_rows: int = 0, one_task_rows: int = ONE_TASK_ROWS, block_rows: int = 0) -> list["HistogramTreesModel"]:
    """Forests by Gini impurity: a tree's bag gives each row a Poisson(1) weight, a
    node may split on sqrt(features) of them, leaves hold ``min_leaf`` bag rows and
    the class shares of their weight. As many trees as ``LEVEL_BYTES`` of sums allow
    grow in the same jobs, one job a level."""
    spark, features = rows.sparkSession, list(features)
    cuts = cut_points(rows.where(F.col(label).isNotNull()), features, max_bins)
    bins, size, many = max(map(len, cuts), default=0) + 2, 2 ** (depth + 1) - 1, len(fits)
    blocks, n = _packed(rows, features, cuts, bins, F.xxhash64(*key), F.col(label), F.col(weight) if weight else F.lit(1.0),
                        F.col(fold) if fold else F.lit(-1), max_rows, one_task_rows, block_rows)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    wide = max(1, int(np.ceil(np.sqrt(len(features)))))
    tree_bytes = 8 * 2 ** (depth - 1) * wide * bins * (classes + 1)
    at_once = max(1, LEVEL_BYTES // tree_bytes)
    if n <= one_task_rows:  # tasks enough for all slots
        at_once = min(at_once, -(-many * trees // (2 * spark_slots(rows))))
    order = np.argsort(np.arange(many * trees) % trees, kind="stable")  # fits share their trees' bags
    batches = [order[at: at + at_once] for at in range(0, many * trees if n else 0, at_once)]

    def empty(own):
        return np.full((len(own), size), -1, np.int16), np.zeros((len(own), size), np.int16), np.zeros((len(own), size, classes))

    def subset(own, level):
        """The features that a node may split on, in order: (tree, node of the level, some)."""
        nodes = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
        salt = ((own[:, None] % trees) * size + nodes).astype(np.uint64)
        draw = _draws(salt[..., None] * np.uint64(len(features)) + np.arange(len(features), dtype=np.uint64), seed + 1, 0)
        return np.sort(np.argsort(draw, -1, kind="stable")[..., :wide], -1)

    def sums(b, feature, cut, own, some, level):
        """(tree, node of the level, one of its features, bin, stat): bag weights and, by
        class, their class weights in units, of a chunk's rows."""
        first, width, slots = 2 ** level - 1, 2 ** level, classes
        features_, flat, y = b["x"].shape[1], np.ascontiguousarray(b["x"]).ravel(), b["y"].astype(np.intp)
        if len(y) and (y.min() < 0 or y.max() >= classes):  # of no class
            y, slots = np.where((y < 0) | (y >= classes), classes, y), classes + 1
        inside, size, last = _in_fit(b["fold"], fits), width * bins * slots, None
        out = np.zeros((len(own), wide, classes + 1, width * bins), np.int64)
        for i, tree in enumerate(own.tolist()):
            if tree % trees != last:
                last = tree % trees
                bag = bag_weight(b["key"], seed, last)
            r = np.flatnonzero((bag > 0) & inside[tree // trees])
            n = nodes_of(flat, r * features_, feature[i], cut[i], level) - first
            r, n = r[n >= 0], n[n >= 0]
            w, base, at = bag.take(r).astype(float), r * features_, n * (bins * slots) + y.take(r)
            unit = np.round(w * b["w"].take(r) * (1 << 20)) if weight else None
            for j in range(wide):
                place = at + flat.take(base + some[i, :, j].take(n)).astype(np.intp) * slots
                count = np.bincount(place, w, size).astype(np.int64).reshape(-1, slots)  # integers below 2^53 are exact
                of_class = np.bincount(place, unit, size).astype(np.int64).reshape(-1, slots) if weight else count << 20
                out[i, j, 0], out[i, j, 1:] = count.sum(1), of_class[:, :classes].T
        return np.ascontiguousarray(out.reshape(len(own), wide, classes + 1, width, bins).transpose(0, 3, 1, 4, 2))

    def grow(total, own):
        tree = empty(own)
        for level in range(depth):
            some = subset(own, level)
            _grow_forest(total(tree, some, level), *tree, some, 2 ** level - 1, level == depth - 1, min_leaf)
        return tree
    if n <= one_task_rows:
        def batch(items):
            chunks = {}
            for at, b in items:
                chunks.setdefault(at, []).append(b)
            for at, held in chunks.items():
                yield at, grow(lambda tree, some, level: sum(sums(b, *tree[:2], batches[at], some, level) for b in held), batches[at])
        each = blocks.flatMap(lambda b: [(i, b) for i in range(len(batches))]).partitionBy(max(1, len(batches)), int).mapPartitions(batch)
        grown = [t for _, t in sorted(each.collect(), key=lambda x: x[0])]
    else:
        grown = [grow(lambda tree, some, level, own=own: _total(blocks, lambda b, f=tree[0].copy(), c=tree[1].copy(): sums(
            b, f, c, own, some, level), len(own) * tree_bytes), own) for own in batches]
    blocks.unpersist()
    place = np.argsort(order)
    feature, cut, value = (np.concatenate([g[j] for g in grown])[place] if grown else empty(np.zeros(0, int))[j] for j in range(3))
    per = lambda x, i: x.reshape(many, -1, *x.shape[1:])[i] if len(x) else x
    return [HistogramTreesModel.of(kind="forest", features=features, cuts=cuts, bins=bins, depth=depth, start=np.zeros(classes),
                                   feature=per(feature, i), cut=per(cut, i), value=per(value, i)) for i in range(many)]


def _grow_forest(s, feature, cut, value, subset, first, last, min_leaf) -> None:
    """Split the nodes of a level by the largest drop of Gini impurity."""
    left = s.cumsum(3)
    whole = left[:, :, :1, -1:, :]
    right = whole - left

    def purity(x):
        c = x[..., 1:].astype(float)
        total = c.sum(-1)
        return np.divide((c * c).sum(-1), total, out=np.zeros_like(total), where=total > 0)
    gain = purity(left) + purity(right) - purity(whole)
    gain = np.where((left[..., 0] >= min_leaf) & (right[..., 0] >= min_leaf), gain, -1.0).reshape(*gain.shape[:2], -1)
    best = gain.argmax(-1)
    ok = np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-9 * (1 << 20)
    share = lambda x: x[1:] / max(1, x[1:].sum())
    for t, n in zip(*np.nonzero(whole[:, :, 0, 0, 0] > 0)):
        node = first + n
        value[t, node] = share(whole[t, n, 0, 0])
        if not ok[t, n]:
            continue
        f, c = divmod(int(best[t, n]), s.shape[3])
        feature[t, node], cut[t, node] = subset[t, n, f], c
        if last:
            value[t, 2 * node + 1], value[t, 2 * node + 2] = share(left[t, n, f, c]), share(right[t, n, f, c])


class HistogramTreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble: adds ``probability`` (a vector by class) and ``prediction``."""

    state = Param(Params._dummy(), "state", "trees, cuts and start as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._set(featuresCol="features")
        self._arrays = None

    @classmethod
    def of(cls, **state) -> "HistogramTreesModel":
        out = cls()
        kept = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in state.items()}
        out._set(state=json.dumps(kept))
        return out

    @property
    def arrays(self) -> dict:
        if self._arrays is None:
            s = json.loads(self.getOrDefault("state"))
            self._arrays = s | {k: np.array(s[k], t) for k, t in (("feature", np.int16), ("cut", np.int16), ("value", float), ("start", float))}
        return self._arrays

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the splits on each feature."""
        f = self.arrays["feature"]
        n = np.bincount(f[f >= 0].ravel(), minlength=len(self.arrays["features"])).astype(float)
        return Vectors.dense(n / max(1.0, n.sum()))

    def _transform(self, rows: DataFrame) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(self.arrays)  # trees: a size of their own, not the rows'

        @F.pandas_udf("array<double>")
        def probability(x):
            import pandas as pd
            return pd.Series(list(predicted(sent.value, np.array(x.tolist(), float).reshape(len(x), -1))))
        out = rows.withColumn("probability", array_to_vector(probability(vector_to_array(self.getFeaturesCol()))))
        arr = vector_to_array("probability")
        return out.withColumn("prediction", (F.array_position(arr, F.array_max(arr)) - 1).cast("double"))


def predicted(a: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities (rows x classes) of feature rows."""
    b, size, classes = binned(x, a["cuts"], a["bins"]), a["feature"].shape[-1], len(a["start"])
    if a["kind"] == "boosting":
        z = np.repeat(a["start"][None], len(x), 0)
        for f, c, v in zip(a["feature"], a["cut"], a["value"]):  # rounds, in order
            z += np.take_along_axis(v, walk(b, f, c, a["depth"]), 1).T
        return softmax(z)
    total, flat, base = np.zeros((len(x), classes)), b.ravel(), np.arange(len(x)) * b.shape[1]
    for f, c, v in zip(a["feature"].reshape(-1, size), a["cut"].reshape(-1, size), a["value"].reshape(-1, size, classes)):
        total += v[nodes_of(flat, base, f, c, a["depth"])]
    total[total.sum(1) == 0] = 1  # nothing was learned: all classes alike
    return total / total.sum(1, keepdims=True)
