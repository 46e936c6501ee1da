"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy, with calibrated
rejection.

Method
------
1. A text is lower-cased and every character that is no letter becomes a space.
   Its subwords are the runs of 1 to 4 characters inside a word, a space on
   either side standing for the word's edge. Each is hashed into one of
   ``BUCKETS`` rows of an embedding table; the text's vector is the mean of its
   subwords' embeddings, over the whole text.
2. A linear softmax over that vector gives the languages. Embeddings and softmax
   are learned together by stochastic gradient descent with momentum in small
   batches, at a rate falling to zero, on a bounded sample of labelled texts:
   per language the ``max_labelled / languages`` different texts of lowest hash.
   Of copies one is learned from. The sample's features (not its texts) meet in
   one task, whose memory the bound fixes.
3. A fifth of the sample (by hash) is kept from the descent. On it a temperature
   is fitted, so that the scores are probabilities, and the lowest score from
   which on ``PRECISION`` of the accepted rows are right: below it a prediction
   is rejected.
4. Prediction is one pass over the documents in place; nothing is shuffled. As the
   mean of embeddings times the softmax's matrix is linear, the two are
   multiplied once, and a text needs its subword counts times a small matrix.

Only the text enters a prediction.

Defined results
---------------
* One row per input row. A null text, and one without a letter, is ``und`` with
  score 0 and ``rejected``.
* ``lang_pred`` is the likeliest learned language, the smaller name on ties;
  ``lang`` is the same, or ``und`` where the prediction is rejected.
* Without a labelled text that has a letter nothing is learned: all rows are
  ``und``. With one language all texts with a letter are that language, score 1.
* Rows without a language, without a text, or for which ``learn`` is not true are
  not learned from. Equal texts with two languages count once for each.
* More than ``MAX_LANGUAGES`` languages are refused: the labels are no languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import with_row

#: rows of the embedding table, width of an embedding, characters of a subword
BUCKETS, WIDTH, SIZES = 8192, 16, (1, 2, 3, 4)
#: labelled texts that the fit takes at most, of all languages together
MAX_LABELLED = 4000
MAX_LANGUAGES = 500
#: parts of a language in which its lowest hashes are found first
SALTS = 64
#: descent
EPOCHS, BATCH, RATE, MOMENTUM, SEED = 25, 32, 4.0, 0.9, 17
#: share of right predictions that accepted rows have on the calibration rows
PRECISION = 0.99
UNKNOWN = "und"


def letters() -> np.ndarray:
    """By code point: is it a letter? (1.1 MB, sent to the workers once)"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subword_counts(text: str | None, is_letter: np.ndarray) -> np.ndarray | None:
    """Subwords per bucket; None for a text without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = is_letter[c]
    if not mark.any():
        return None
    mark = np.concatenate(([False], mark, [False]))
    c = np.where(mark, np.concatenate(([0], c, [0])), 32).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for n in SIZES:
        width = len(c) - n + 1
        if width < 1:
            break
        # inner characters are letters, and at least one is a letter at all
        if n == 1:
            ok = mark
        elif n == 2:
            ok = mark[:width] | mark[1:]
        else:
            ok = mark[1: width + 1].copy()
            for i in range(2, n - 1):
                ok &= mark[i: width + i]
        h = np.full(width, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ c[i: width + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h = h[ok] * np.uint32(0x85EBCA6B)
        out += np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax matrix and offsets learned from rows of subword shares."""
    rnd = np.random.default_rng(SEED)
    emb = rnd.uniform(-1, 1, (x.shape[1], WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32)
    moves = [np.zeros_like(p) for p in (emb, out, bias)]
    steps, done = epochs * -(-len(x) // BATCH), 0
    for _ in range(epochs):
        order = rnd.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at: at + BATCH]
            b = x[rows]
            hidden = b @ emb
            g = softmax(hidden @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            lr = rate * (1 - done / steps)
            for p, move, grad in zip((emb, out, bias), moves, (b.T @ (g @ out.T) * 20, hidden.T @ g, g.sum(axis=0) * 0.1)):
                move *= MOMENTUM
                move -= lr * (1 - MOMENTUM) * grad
                p += move
            done += 1
    return emb, out, bias


def calibrate(z: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """Temperature of least log loss, and the lowest score that keeps ``precision``
    among the rows at or above it (the highest score, if none does). The loss is
    taken against targets short of 0 and 1 by one row in all rows, as else rows
    that are all right would ask for scores of exactly 1."""
    if not len(z):
        return 1.0, 0.0
    aim = np.full(z.shape, 1 / (len(y) + 2) / max(1, z.shape[1] - 1))
    aim[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)
    loss = lambda t: -(aim * np.log(np.maximum(softmax(z / t), 1e-30))).sum(axis=1).mean()
    t = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = softmax(z / t)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) >= precision * np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] < score[order][:-1], True)  # rows of one score are accepted together
    ok = np.flatnonzero(good & last)
    return t, float(score[order][ok[-1]] if len(ok) else score.max())


def fit_model(langs: list[str], counts: list[np.ndarray], held: list[bool], precision: float = PRECISION) -> dict:
    """The model of labelled subword counts; ``held`` rows calibrate it."""
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs], np.int64)
    x = np.zeros((len(counts), BUCKETS), np.float32)
    for i, c in enumerate(counts):
        x[i] = c / max(1, c.sum())
    held = np.array(held, bool)
    if held.all():
        held[:] = False
    emb, out, bias = descend(x[~held], y[~held], len(names))
    matrix = (emb.astype(np.float64) @ out).astype(np.float32)
    t, reject = calibrate(x[held] @ matrix + bias, y[held], precision)
    return {"langs": names, "matrix": matrix, "bias": bias, "temperature": t, "reject": reject}


class Predictor:
    """Languages and scores of texts by one model."""

    def __init__(self, model: dict, is_letter: np.ndarray):
        self.model, self.is_letter = model, is_letter

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        m = self.model
        best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for i, text in enumerate(texts):
            c = subword_counts(text, self.is_letter) if m["langs"] else None
            if c is None:
                continue
            z = (c.astype(np.float32) / np.float32(c.sum())) @ m["matrix"] + m["bias"]
            p = softmax(z[None].astype(np.float64) / m["temperature"])[0]
            best[i], score[i] = m["langs"][int(p.argmax())], min(1.0, float(p.max()))
        known = np.array([b != UNKNOWN for b in best], bool)
        return best, score, ~(known & (score >= m["reject"]))


def labelled_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, max_labelled: int) -> DataFrame:
    """``(lang, h, text)``: per language the texts of lowest hash, copies once."""
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    one = rows.groupBy("lang", "h").agg(F.min("id").alias("id"))
    n = one.select(F.count_distinct("lang")).first()[0]
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} different labels: more than {MAX_LANGUAGES} are no languages")
    if not n:
        return rows.select("lang", "h", "text").limit(0)
    # lowest hashes of every part of a language first, so that a large one is no task's alone
    for by in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):
        one = one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("rank") <= max(1, max_labelled // n))
    picked = one.drop("rank")
    # at most max_labelled ids and hashes
    return (rows.join(F.broadcast(picked), ["lang", "h", "id"]).groupBy("lang", "h").agg(F.first("text").alias("text")))


_FEATURES = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("cols", T.BinaryType()),
                          T.StructField("counts", T.BinaryType())])
_MODEL = T.StructType([T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("matrix", T.BinaryType()),
                       T.StructField("bias", T.BinaryType()), T.StructField("temperature", T.DoubleType()),
                       T.StructField("reject", T.DoubleType())])


def train(docs: DataFrame, learn: Column | str = "true", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
          max_labelled: int = MAX_LABELLED, precision: float = PRECISION) -> dict:
    """The model: a matrix of ``BUCKETS`` x languages, offsets, temperature, threshold."""
    learn = F.expr(learn) if isinstance(learn, str) else learn
    is_letter = docs.sparkSession.sparkContext.broadcast(letters())  # fixed size

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(v, h, c) for v, h, t in zip(b["lang"].to_pylist(), b["h"].to_pylist(), b["text"])
                     if (c := subword_counts(t.as_py(), is_letter.value)) is not None]
            cols = [np.flatnonzero(c) for _, _, c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([k.astype(np.uint16).tobytes() for k in cols], pa.binary()),
                 pa.array([f[2][k].astype(np.int64).tobytes() for f, k in zip(found, cols)], pa.binary())], names=_FEATURES.names)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b[c].to_pylist() for c in _FEATURES.names)))
        counts = []
        for _, _, cols, n in rows:
            c = np.zeros(BUCKETS, np.int64)
            c[np.frombuffer(cols, np.uint16)] = np.frombuffer(n, np.int64)
            counts.append(c.astype(np.float32))
        if rows:
            m = fit_model([r[0] for r in rows], counts, [r[1] % 5 == 0 for r in rows], precision)
            yield pa.RecordBatch.from_pylist([{**m, "matrix": m["matrix"].tobytes(), "bias": m["bias"].tobytes()}],
                                             schema=pa.schema([("langs", pa.list_(pa.string())), ("matrix", pa.binary()), ("bias", pa.binary()),
                                                               ("temperature", pa.float64()), ("reject", pa.float64())]))
    sample = labelled_sample(docs, learn, id_col, text_col, lang_col, max_labelled).mapInArrow(features, _FEATURES)
    got = sample.repartition(1).mapInArrow(learned, _MODEL).first()
    if got is None:
        return {"langs": [], "matrix": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0, np.float32), "temperature": 1.0, "reject": 0.0}
    n = len(got["langs"])
    return {"langs": list(got["langs"]), "matrix": np.frombuffer(bytes(got["matrix"]), np.float32).reshape(BUCKETS, n),
            "bias": np.frombuffer(bytes(got["bias"]), np.float32), "temperature": got["temperature"], "reject": got["reject"]}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", *, carry: bool = False) -> DataFrame:
    """Per document ``doc_id``, ``lang_pred``, ``score``, ``rejected`` and ``lang``."""
    sent = docs.sparkSession.sparkContext.broadcast((model, letters()))  # fixed size: buckets x languages
    rows = with_row(docs, carry, doc_id=F.col(id_col), text=F.col(text_col))
    keep = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType(keep + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                  T.StructField("rejected", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(*sent.value)
        for b in batches:
            best, score, rejected = predict(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b[f.name] for f in keep] + [pa.array(best, pa.string()), pa.array(score), pa.array(rejected)],
                                             names=[f.name for f in schema.fields])
    out = rows.mapInArrow(work, schema)
    return out.withColumn("lang", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_pred")))


#: the rows that are kept from learning
HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0, false)"


def held_out_report(docs: DataFrame) -> DataFrame:
    """Languages of all documents by a model that has seen no held-out row: ``doc_id``,
    ``held_out``, ``lang_pred``, ``score``, ``rejected``. A row without an id is
    neither held out nor learned from."""
    out = identify(docs, train(docs, F.expr(f"doc_id IS NOT NULL AND NOT {HELD_OUT}")))
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
