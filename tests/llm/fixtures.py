"""Documents for the tests: the smallest generated table, and hand-made rows
with nulls, empty and long texts, ties, repeats and clashing extra columns."""
import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns named like internal ones
    T.StructField("uid", T.StringType()), T.StructField("key", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("size", T.StringType())])


def rows():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "ÉPSILON", "zeta", "eta", "theta", "<|endoftext|>", "don't", "x1", "…", "　", "é́"]
    base = " ".join(rnd.choice(words) for _ in range(400))
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(30_000))
    texts = [None, "", " \t\n", "a", "a ", " a", "b c", base, base, base + " ", base.replace(" ", "\n"), base[: len(base) // 2],
             base + " tail", long, "z" * 5000, "ab" * 3000, "line one\nline one\nline two\n\n \nline one", "# $ % & | < >",
             "one two three one two three", "\x1c\x1d\x85\xa0  x"]
    out = [(i, t, "en", ["s1", "s2", None][i % 3], len(t or ""), "u", "k", "r", "t", "z") for i, t in enumerate(texts)]
    out += [out[7], out[7], out[4], (None, base, None, None, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None, None)]
    return out


def tricky(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
