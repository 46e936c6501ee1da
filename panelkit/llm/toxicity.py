"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a logistic model over the
``SELECTED`` hashed word features that tell it best (chi-square) plus the
probabilities of the categories before it. In training these probabilities are out-of-fold predictions, so later
models learn from errors as large as those they will meet; in scoring they come
from the final models.

* The labelled sample is at most ``MAX_LABELLED`` rows, chosen by the hash of the
  id; only this bounded list of ids is broadcast, so no text is moved for it.
* Features of a text: its different words (letters, lower case), their prefixes
  and the symbols they end in, hashed to a fixed number of columns. A document's
  score is then a sum over its different words, and tasks score each word once
  while a cache bounded in words and letters holds it. Every document is scored over its whole text.
* A category is assigned above the threshold that had the best F1 out of fold.

Defined results: null or blank texts have no words and score the intercept;
null labels are not used; of several labels of an id the greatest count; a category without both kinds of labels in the sample
gets probability 0 (or 1) for all; empty table, empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import with_row, write_shared

#: bound on the labelled rows the chain is fitted on
MAX_LABELLED = 20_000
FOLDS = 3
COLUMNS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
#: chain order: name and the condition on the label columns
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 AND quality = 0"))
#: columns a model is fitted on, and sample rows a column must be in
SELECTED = 2000
MIN_ROWS = 3
REGULARISATION = 1e-3
MAX_ITERATIONS = 60
TOLERANCE = 1e-7
#: bounds on a worker's cached tokens: their number, and the letters of one
CACHE_WORDS = 60_000
CACHE_LETTERS = 40
#: thresholds tried out of fold
GRID = tuple(i / 50 for i in range(5, 46))


def columns_of(token: str) -> list[int]:
    """Feature columns of one token (lower case, cut at white space)."""
    import xxhash

    core = token.strip(_EDGES)
    names = ["w" + core] + [f"p{core[:n]}" for n in PREFIXES if len(core) > n] if core else []
    tail = token[len(token.rstrip(_EDGES)):]
    if tail:
        names.append("t" + tail)
    return [xxhash.xxh64_intdigest(n.encode(), 7) & (COLUMNS - 1) for n in names]


#: ASCII punctuation and digits at the edges of a token
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


def tokens_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Columns with their counts of different words."""
    count: dict[int, int] = {}
    for token in tokens_of(text):
        for c in columns_of(token):
            count[c] = count.get(c, 0) + 1
    cols = sorted(count)
    return cols, [float(count[c]) for c in cols]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, chain, max_labelled: int, folds: int) -> DataFrame:
    """Feature rows ``(doc_id, fold, y0.., cols, vals)`` of a bounded sample."""
    marks = labels.select(F.col(id_col).alias("doc_id"), *[
        F.expr(f"CAST({cond} AS double)").alias(f"y{i}") for i, (_, cond) in enumerate(chain)])
    marks = marks.where(" AND ".join(f"y{i} IS NOT NULL" for i in range(len(chain)))).groupBy("doc_id").agg(
        F.max(F.struct(*[f"y{i}" for i in range(len(chain))])).alias("y")).select("doc_id", "y.*")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")
    keep = ["doc_id", *[f"y{i}" for i in range(len(chain))]]
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in keep[1:]] + [
        T.StructField("cols", T.ArrayType(T.IntegerType())), T.StructField("vals", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in keep] + [pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                                        pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                names=[f.name for f in schema.fields])
    rows = texts.select(*[F.col(c).cast("long" if c == "doc_id" else "double").alias(c) for c in keep], "text").mapInArrow(work, schema)
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int"))


def column_counts(rows: DataFrame, n_labels: int) -> DataFrame:
    """Per word column and fold: sample rows that have it, and those of each label."""
    return (rows.select("fold", *[f"y{i}" for i in range(n_labels)], F.explode("cols").alias("col"))
            .groupBy("col", "fold").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"n{i}") for i in range(n_labels)]))


def select_columns(counts: DataFrame, totals: list, label: int, left_out: int | None) -> list[int]:
    """The columns that tell a label best (chi-square) on all folds but one."""
    size = sum(r["n"] for r in totals if r["fold"] != left_out)
    pos = sum(r[f"n{label}"] for r in totals if r["fold"] != left_out)
    c = counts if left_out is None else counts.where(F.col("fold") != left_out)
    c = c.groupBy("col").agg(F.sum("n").alias("n"), F.sum(f"n{label}").alias("p")).where(F.col("n") >= MIN_ROWS)
    n, p = F.col("n"), F.col("p")
    gap = p * (size - pos) - (n - p) * pos
    chi = gap * gap * size / (F.lit(float(pos)) * (size - pos) * n * (size - n + 1))
    return [r[0] for r in c.select("col", chi.alias("chi")).orderBy(F.desc("chi"), "col").limit(SELECTED).collect()]


def fit_logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Weights of ``width`` sparse and of the dense columns, then the intercept: the
    mean logistic loss with a squared penalty on all but the intercept, by L-BFGS."""
    n, sign = len(y), np.where(y > 0, 1.0, -1.0)

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        m = sign * (np.bincount(row, val * t[col], n) + dense @ t[width:-1] + t[-1])
        r = -sign * np.exp(-np.logaddexp(0.0, m)) / n
        g = np.concatenate([np.bincount(col, val * r[row], width), dense.T @ r, [r.sum()]])
        g[:-1] += REGULARISATION * t[:-1]
        return np.logaddexp(0.0, -m).mean() + REGULARISATION / 2 * t[:-1] @ t[:-1], g

    t = np.zeros(width + dense.shape[1] + 1)
    t[-1] = math.log(y.sum() / (n - y.sum()))
    (f, g), pairs = loss(t), []
    for _ in range(MAX_ITERATIONS):
        q, tried = g.copy(), []
        for ds, dg, rho in reversed(pairs):
            tried.append(rho * (ds @ q))
            q -= tried[-1] * dg
        if pairs:
            ds, dg, rho = pairs[-1]
            q *= 1 / (rho * (dg @ dg))
        for (ds, dg, rho), a in zip(pairs, reversed(tried)):
            q += (a - rho * (dg @ q)) * ds
        slope, step = -(g @ q), 1.0 if pairs else 1.0 / max(1.0, float(np.abs(g).sum()))
        while True:
            t2 = t - step * q
            f2, g2 = loss(t2)
            if f2 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        done = f - f2 <= TOLERANCE * max(1.0, abs(f))
        if (t2 - t) @ (g2 - g) > 1e-12:
            pairs = [*pairs, (t2 - t, g2 - g, 1 / ((t2 - t) @ (g2 - g)))][-10:]
        t, f, g = t2, f2, g2
        if done:
            break
    return t


def _sample_arrays(batches: Iterator[pa.RecordBatch], n_labels: int, wanted: np.ndarray):
    """The sample in order of its ids, cut to the ``wanted`` columns batch by batch."""
    ids, folds, ys, row, col, val, at = [], [], [], [], [], [], 0
    place = np.full(COLUMNS, -1, dtype=np.int32)
    place[wanted] = np.arange(len(wanted), dtype=np.int32)
    for b in batches:
        cols, vals = b["cols"], b["vals"]
        here = place[cols.flatten().to_numpy(zero_copy_only=False)]
        owner = np.repeat(np.arange(b.num_rows, dtype=np.int32) + at, np.diff(cols.offsets.to_numpy()))
        row.append(owner[here >= 0])
        col.append(here[here >= 0])
        val.append(vals.flatten().to_numpy(zero_copy_only=False)[here >= 0].astype(np.float32))
        ids.append(b["doc_id"].to_numpy(zero_copy_only=False))
        folds.append(b["fold"].to_numpy(zero_copy_only=False))
        ys.append(np.stack([b[f"y{i}"].to_numpy(zero_copy_only=False) for i in range(n_labels)], 1))
        at += b.num_rows
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(at, dtype=np.int32)
    rank[order] = np.arange(at, dtype=np.int32)
    row = rank[np.concatenate(row)]
    by = np.lexsort((np.concatenate(col), row))
    return (np.concatenate(folds)[order], np.concatenate(ys)[order], row[by], np.concatenate(col)[by], np.concatenate(val)[by].astype(np.float64))


def best_threshold(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The middle one of the thresholds with the best F1, and that F1."""
    f1 = [2 * float(((p > t) & (y == 1)).sum()) / max(1.0, float((p > t).sum() + y.sum())) for t in GRID]
    near = [t for t, v in zip(GRID, f1) if v >= max(f1) - 1e-12]
    return near[len(near) // 2], max(f1)


def _chain_task(chain, chosen: dict, wanted: np.ndarray):
    """The fit of the whole chain as one task over the bounded sample."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, ys, row, col, val = _sample_arrays(batches, len(chain), wanted)
        before, out = np.zeros((len(fold), 0)), []

        def fit(i: int, left_out: int | None, rows: np.ndarray) -> np.ndarray:
            local = np.full(len(wanted), -1, dtype=np.int32)
            columns = np.searchsorted(wanted, chosen[i, left_out])
            local[columns] = np.arange(len(columns), dtype=np.int32)
            number = np.cumsum(rows, dtype=np.int64) - 1
            use = rows[row] & (local[col] >= 0)
            return fit_logistic(number[row[use]], local[col[use]], val[use], before[rows], ys[rows, i], len(columns))

        def predict(i: int, left_out: int | None, t: np.ndarray) -> np.ndarray:
            weight = np.zeros(len(wanted))
            weight[np.searchsorted(wanted, chosen[i, left_out])] = t[:len(chosen[i, left_out])]
            z = np.bincount(row, val * weight[col], len(fold)) + before @ t[len(chosen[i, left_out]):-1] + t[-1]
            return np.exp(-np.logaddexp(0.0, -z))

        for i, (name, _) in enumerate(chain):
            if (i, None) not in chosen:  # one kind of label only
                sure = float(ys[:, i].sum() > 0)
                out.append((name, [], [], [0.0] * i, 800.0 if sure else -800.0, 0.5, None))
                before = np.column_stack([before, np.full(len(fold), sure)])
                continue
            # out-of-fold probabilities: every fold by a model that has not seen it, columns chosen without it
            p = np.zeros(len(fold))
            for f in np.unique(fold).tolist():
                if (i, f) in chosen:
                    p[fold == f] = predict(i, f, fit(i, f, fold != f))[fold == f]
            t = fit(i, None, np.ones(len(fold), dtype=bool))
            n = len(chosen[i, None])
            threshold, f1 = best_threshold(p, ys[:, i])
            out.append((name, [int(c) for c in chosen[i, None]], t[:n].tolist(), t[n:-1].tolist(), float(t[-1]), threshold, f1))
            before = np.column_stack([before, p])
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), (
            pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["name", "columns", "weights", "before", "intercept", "threshold", "oof_f1"])
    return work


MODEL_ROW = ("name string, columns array<int>, weights array<double>, before array<double>, intercept double, threshold double, "
             "oof_f1 double")


def fit_chain(sample: DataFrame, chain=CHAIN, folds: int = FOLDS) -> list[dict]:
    """Per category: ``weights`` (of word columns), ``before`` (of the earlier
    probabilities), ``intercept`` and ``threshold``. Columns are counted and chosen by
    Spark; the models are fitted in one task, which holds the chosen columns of at most
    ``MAX_LABELLED`` rows."""
    rows = write_shared(sample, "toxic-sample")
    totals = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"n{i}") for i in range(len(chain))]).collect()
    if not totals:
        return [{"name": name, "weights": {}, "before": [0.0] * i, "intercept": -800.0, "threshold": 0.5} for i, (name, _) in enumerate(chain)]
    counts = write_shared(column_counts(rows, len(chain)), "toxic-columns")
    chosen = {}
    for i in range(len(chain)):
        for f in [None, *sorted(r["fold"] for r in totals)]:
            some = [r for r in totals if r["fold"] != f]
            if 0 < sum(r[f"n{i}"] for r in some) < sum(r["n"] for r in some):
                chosen[i, f] = np.array(sorted(select_columns(counts, totals, i, f)), dtype=np.int64)
    wanted = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *chosen.values()]))
    fitted = rows.coalesce(1).mapInArrow(_chain_task(chain, chosen, wanted), MODEL_ROW).collect()  # at most SELECTED weights a category
    return [r.asDict() | {"weights": dict(zip(r["columns"], r["weights"]))} for r in fitted]


class Scorer:
    """Chain probabilities of texts; the weight of a token is summed once."""

    def __init__(self, models: list[dict]):
        self.models, self.cache = models, {}
        #: weights of a column in all models
        self.columns = {c: [m["weights"].get(c, 0.0) for m in models] for c in {c for m in models for c in m["weights"]}}

    def token(self, token: str) -> tuple[float, ...]:
        """A token's weight in each model; empty if it has none anywhere."""
        hits = [self.columns[c] for c in columns_of(token) if c in self.columns]
        got = tuple(map(sum, zip(*hits)))
        if len(token) <= CACHE_LETTERS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[token] = got
        return got

    def score(self, text: str | None) -> list[float]:
        sums = [m["intercept"] for m in self.models]
        cache = self.cache
        for token in tokens_of(text):
            got = cache.get(token)
            if got is None:
                got = self.token(token)
            if got:
                for i, w in enumerate(got):
                    sums[i] += w
        out: list[float] = []
        for m, s in zip(self.models, sums):
            z = s + sum(w * p for w, p in zip(m["before"], out) if w)
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, chain=CHAIN,
             max_labelled: int = MAX_LABELLED, folds: int = FOLDS, carry: bool = False) -> DataFrame:
    """Per document ``doc_id`` and of every category ``p_<name>`` and ``<name>`` (boolean)."""
    sample = labelled_sample(docs, labels, id_col, text_col, chain, max_labelled, folds)
    return apply_chain(docs, fit_chain(sample, chain, folds), id_col, text_col, carry=carry)


def apply_chain(docs: DataFrame, models: list[dict], id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([models])  # fixed size: the columns with a weight
    rows = with_row(docs, carry, doc_id=F.col(id_col), text=F.col(text_col))
    keep = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType(keep + [T.StructField(f"p_{m['name']}", T.DoubleType()) for m in models])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process keeps its cache of tokens from task to task
        if len(sent.value) == 1:
            sent.value.append(Scorer(sent.value[0]))
        scorer = sent.value[1]
        for b in batches:
            p = np.array([scorer.score(t.as_py()) for t in b["text"]], dtype=np.float64).reshape(b.num_rows, len(schema) - len(keep))
            yield pa.RecordBatch.from_arrays([b[f.name] for f in keep] + [pa.array(c) for c in p.T], names=[f.name for f in schema.fields])
    out = rows.mapInArrow(work, schema)
    return out.select("doc_id", *[c for m in models for c in (
        F.col(f"p_{m['name']}"), (F.col(f"p_{m['name']}") > m["threshold"]).alias(m["name"]))], *(["row"] if carry else []))
