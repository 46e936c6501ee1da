"""Phrase collocation mining after Toivonen: a sample proposes phrases, one full
pass counts the proposals and their negative border exactly, and border phrases
that turn out frequent start further passes until nothing is left uncounted.

Method
------
1. A text becomes pieces and pieces words, on its UTF-8 bytes. A phrase is 1 to
   ``MAX_WORDS`` words in a row inside a piece, counted per language with overlaps.
   A phrase is never more frequent than one it contains.
2. Sample: a ``SAMPLE`` share of the documents, by the hash of their places, is counted
   without any threshold on their parts; words and pairs found ``sample_min`` times
   are proposed. The sample decides what is counted when, never what is returned.
3. Full pass over all documents: a word is counted always, a longer phrase if both
   its parts (all but the last word, all but the first) are proposed. This is the
   proposals and their negative border: the phrases that are not proposed although
   their parts are.
4. Border failures: words and pairs of the border that are frequent are added to the
   proposals, and a further pass counts the phrases that have both parts among the
   proposals only now. No phrase is counted in two passes. A pass without failures
   closes the search, then every frequent phrase has its exact count; as phrases have
   at most ``MAX_WORDS`` words there are at most that many passes.
5. Proposals reach the tasks as bitmaps of hashes, 8 to 16 bits a proposal and at
   most ``MAX_BITS`` (32 MB), built by Spark's bitmap aggregate. Two phrases on one
   bit only make a task count a phrase it need not have counted; at any size, even
   with all bits set, counts and results are the same.
6. A task counts ``CHUNK`` bytes of whole texts at a time, in arrays of word numbers
   (a longer text by itself), and hands each chunk's counts on, so its memory does
   not grow with its share of the texts; Spark sums them by phrase, in the task first.
7. Scores, the drop of phrases inside longer ones and the first rows of a language
   are joins, aggregates and a ranked window over the frequent phrases, JVM-side;
   products are exact decimals.

Defined results
---------------
* A null text is empty. A null language counts as ``und``, together with rows whose
  language is that text. Repeated rows count each time.
* Words are bytes between spaces and tabs: other white space is part of a word, and
  upper case beyond A-Z stays. An empty table gives an empty result.
* ``n``: all word occurrences of the language, of phrases of any frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import write_shared

MAX_WORDS = 3
#: share of the documents in the sample, and occurrences there that propose a phrase
SAMPLE, SAMPLE_MIN = 0.1, 2
#: bits of a proposal bitmap at least and at most
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
#: bytes of texts that a task counts at once
CHUNK = 1 << 23
#: parts of a language in which its phrases are ranked first
SALTS = 64
UNKNOWN = "und"

#: the ends of pieces become line ends, A-Z become a-z; every byte stays one byte
_FOLD = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))

_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.BinaryType()), T.StructField("n", T.LongType())])
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a phrase from the hashes of its first words and of its last word."""
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(lang: str, words: list[bytes]) -> list[int]:
    seed = xxhash.xxh32_intdigest(lang)
    return [xxhash.xxh64_intdigest(w, seed) for w in words]


class Bitmap:
    """Proposals as set bits; ``None`` in place of bits proposes everything."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        at = h & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def words_of(texts: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray]:
    """The texts' words as numbers from 1, a 0 after every piece, and the words by number."""
    data = b"" if texts.buffers()[2] is None else texts.buffers()[2].to_pybytes().translate(_FOLD)
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(data)], offset=texts.offset)
    lists = pc.ascii_split_whitespace(pc.list_flatten(pc.split_pattern(folded, "\n")))
    words = pc.list_flatten(lists)
    piece = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)  # white space at a piece's ends leaves empty words
    code = words.filter(some).dictionary_encode()
    piece = piece[some.to_numpy(zero_copy_only=False)]
    out = np.zeros(len(piece) + len(lists), np.int64)
    out[np.arange(len(piece)) + piece] = code.indices.to_numpy() + 1
    return out, code.dictionary.view(pa.binary())


def chunk_counts(lang: str, texts: pa.BinaryArray, now: list[Bitmap], before: list[Bitmap] | None,
                 longest: int = MAX_WORDS) -> Iterator[pa.RecordBatch]:
    """Exact counts of the phrases that this pass is to count, in texts of one language.

    ``now`` and ``before`` are the proposals (words, pairs) of this pass and of the
    pass before (None: there is none): a phrase is counted if its parts are in
    ``now`` and not all in ``before``, a word in the first pass only."""
    t, words = words_of(texts)
    if not len(words):
        return
    bits, hashes = len(words).bit_length(), np.array([0, *word_hashes(lang, words.to_pylist())], np.uint64)
    had = lambda i, h: before[i].has(h) if before else np.zeros(len(h), bool)  # noqa: E731

    def rows(*cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Equal phrases counted, by word numbers that make one key."""
        if bits * len(cols) <= 63:
            key = reduce(lambda x, y: x << bits | y, cols)
        else:  # too large for one key: number the pairs first
            key = np.unique(cols[0] << bits | cols[1], return_inverse=True)[1] << bits | cols[2]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        for at in range(0, len(first), 1 << 16):
            f = first[at: at + (1 << 16)]
            parts = [words.take(pa.array(c[f] - 1)) for c in cols]
            phrase = pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]
            langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(f), np.int64)))
            yield pa.RecordBatch.from_arrays([langs, phrase, pa.array(n[at: at + (1 << 16)])], schema=_ARROW)
    # by word number, then by place in the texts
    word, old_word = now[0].has(hashes), had(0, hashes)
    if before is None:
        yield from rows(t[t > 0])
    word[0] = False
    two = np.flatnonzero(word[t[:-1]] & word[t[1:]])
    a, b = t[two], t[two + 1]
    old = old_word[a] & old_word[b]
    yield from rows(a[~old], b[~old])
    if longest < 3:
        return
    h = mixed(hashes[a], hashes[b])
    pair = now[1].has(h)
    old &= had(1, h)
    at = two[:-1][(two[1:] == two[:-1] + 1) & pair[1:] & pair[:-1] & ~(old[1:] & old[:-1])]
    yield from rows(t[at], t[at + 1], t[at + 2])


def counted(texts: DataFrame, now: list, before: list | None, longest: int = MAX_WORDS) -> DataFrame:
    """Sums ``(lang, phrase, n)`` of one pass; proposals are broadcast bitmaps."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = _bitmaps(now), before and _bitmaps(before)
        for table in chunks(batches):
            for lang in table["lang"].unique().to_pylist():
                own = table.filter(pc.equal(table["lang"], lang))["text"].combine_chunks()
                yield from chunk_counts(lang, own if isinstance(own, pa.Array) else own.chunk(0), new, old, longest)
    return texts.mapInArrow(work, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def chunks(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.Table]:
    """Whole texts in tables of about ``CHUNK`` bytes, however large the batches are."""
    held, filled, size = [], 0, size or CHUNK
    for b in batches:
        ends = np.cumsum(pc.binary_length(b["text"]).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size - filled, "right")))
            held.append(b.slice(at, to - at))
            filled += int(ends[to - 1] - done)
            at = to
            if at < b.num_rows or filled >= size:
                yield pa.Table.from_batches(held)
                held, filled = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _bitmaps(sent: list) -> list[Bitmap]:
    return [Bitmap(b and b.value) for b in sent]


_MARKED = T.StructType([*_COUNTS, T.StructField("k", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("known", T.BooleanType())])


def marked(found: DataFrame, now: list) -> DataFrame:
    """Phrases with their number of words ``k``, hash ``h`` and whether they are
    proposed (``known``); these two for words and pairs only."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = _bitmaps(now)
        for b in batches:
            parts = [p.split(b" ") for p in b["phrase"].to_pylist()]
            h = np.zeros((b.num_rows, 2), np.uint64)
            for i, (lang, words) in enumerate(zip(b["lang"].to_pylist(), parts)):
                if len(words) < 3:
                    h[i, : len(words)] = word_hashes(lang, words)
            k = np.array([len(p) for p in parts], np.int32)
            h = np.where(k == 1, h[:, 0], mixed(h[:, 0], h[:, 1]))
            known = np.where(k == 1, maps[0].has(h), (k > 2) | maps[1].has(h))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k), pa.array(h.view(np.int64)), pa.array(known)], names=_MARKED.names)
    return found.mapInArrow(work, _MARKED)


def bitmap(hashes: DataFrame, bits: int, base=None):
    """The hashes ``h`` as a broadcast bitmap, added to ``base``'s bits."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1  # Spark's buckets count from 1
    parts = (hashes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))).collect()
    out = np.zeros(bits // 8, np.uint8) if base is None else base.value.copy()
    for r in parts:  # at most bits / 32768 rows of 4 KB
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        out[(r["b"] - 1) * len(m):][: len(m)] |= m[: len(out)]
    return hashes.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, min_count: int = 10, sample: float = SAMPLE,
                     sample_min: int = SAMPLE_MIN, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Every phrase of 1 to ``MAX_WORDS`` words found ``min_count`` times, with its
    exact count ``(lang, k, phrase, n)``; ``(lang, n)`` words of each language; and
    of every pass the number of border failures by phrase length."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    drawn = texts.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(10_000)) < int(sample * 10_000))
    everything = [None, None]
    drawn = write_shared(marked(counted(drawn, everything, None, 2).where(F.col("n") >= sample_min), everything), "proposals")
    new, now, passes, sizes = [drawn.where(F.col("k") == k) for k in (1, 2)], everything, [], []
    for hashes in new:
        n, bits = hashes.count(), MIN_BITS
        while bits < min(8 * n, max_bits):
            bits *= 2
        sizes.append(bits)
    frequent, words = [], None
    while True:
        before, now = (now if passes else None), [bitmap(h, bits, base) for h, bits, base in zip(new, sizes, now)]
        found = counted(texts, now, before)
        if words is None:  # the first pass counts all words
            found = write_shared(found.where((F.col("n") >= min_count) | (F.locate(" ", F.col("phrase").cast("string")) == 0)), "counts")
            words = write_shared(found.where(F.locate(" ", F.col("phrase").cast("string")) == 0).groupBy("lang").agg(F.sum("n").alias("n")), "words")
        found = write_shared(marked(found.where(F.col("n") >= min_count), now), "counts")
        frequent.append(found)
        new = [found.where((F.col("k") == k) & ~F.col("known")) for k in (1, 2)]
        passes.append({k: f.count() for k, f in zip((1, 2), new)})
        if not any(passes[-1].values()):
            break
    out = reduce(DataFrame.unionByName, frequent).select("lang", "k", F.col("phrase").cast("string").alias("phrase"), "n")
    return out, words, passes


#: floor(1000000 * a * a / (l * r)) in exact decimals, for counts of up to 10^15
SCORE = ("CAST(a AS decimal(15, 0)) * CAST(a AS decimal(15, 0)) * CAST(1000000 AS decimal(7, 0))"
         " div (CAST(l AS decimal(15, 0)) * CAST(r AS decimal(15, 0)))")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, min_count: int = 10, top: int = 2000,
                 inside: int = 50, **mining) -> DataFrame:
    """Per language its ``top`` phrases of 2 and more words by the score of their
    weakest cut, without those that stand inside a longer one in ``inside`` percent
    of their occurrences: ``lang, rank, phrase, a, l, r, n, score``."""
    found, words, _ = frequent_phrases(docs, text_col, lang_col, min_count=min_count, **mining)
    found = write_shared(found, "phrases")
    part = F.split("phrase", " ")
    joined = lambda first, size: F.array_join(F.slice(part, first, size), " ")  # noqa: E731
    cands = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    # every cut of a candidate into its first words and the rest
    cuts = cands.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = write_shared(cuts, "cuts")
    of = lambda name, n: found.select(F.col("lang").alias("lang"), F.col("phrase").alias(name), F.col("n").alias(n))  # noqa: E731
    cuts = write_shared(cuts.join(of("left", "l"), ["lang", "left"]), "cuts").join(of("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(SCORE))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # the most frequent longer candidate around each phrase
    around = found.where(f"k = {MAX_WORDS}").select("lang", "n", F.explode(F.array(joined(F.lit(1), F.lit(MAX_WORDS - 1)), joined(F.lit(2), F.lit(MAX_WORDS - 1)))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    order = [F.desc("m.score"), F.desc("a"), "phrase"]
    # a language's phrases are ranked in SALTS parts first, so that a large one is no task's alone
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"),
                                           "n", F.col("m.score").alias("score"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?

]')), '[^ 	]+') AS w FROM d),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM p
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM p),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
words AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cut AS (
  SELECT lang, k, phrase, a, w, 1 AS cut, w[1] AS le, array_to_string(w[2:], ' ') AS ri FROM c
  UNION ALL SELECT lang, k, phrase, a, w, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE k = 3),
s AS (
  SELECT cut.lang, cut.k, cut.phrase, a, cut, x.n AS l, y.n AS r,
         CAST((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = le JOIN f y ON y.lang = cut.lang AND y.phrase = ri
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS b FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, words.n, score
FROM s JOIN words ON words.lang = s.lang LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase AND s.k = 2
WHERE coalesce(100 * b < 50 * a, true)
QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) <= 2000
"""
