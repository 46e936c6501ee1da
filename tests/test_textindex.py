"""Trigram search equals the scan for patterns of every length."""
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from panelkit.operators import textindex as K


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcAB éß😀") for _ in range(rnd.randrange(12))) for _ in range(300)]
    texts += [None, "", "a", "ab", "abc", "x" * 5000 + "needle", "tail\u0000mark", "Straße", "needle"] + ["hot needle"] * 100
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(5, "repeated id needle", -1), (None, "no id needle", -2)]
    path = tempfile.mkdtemp(prefix="panelkit-grams-")
    df = spark.createDataFrame(rows, "id long, text string, row long")
    df.write.parquet(f"{path}/texts")
    df = spark.read.parquet(f"{path}/texts")
    K.build_index(df, "id", "text", path, 6)
    return df, path


def test_search_equals_the_scan(table):
    df, path = table
    patterns = ["", "a", "É", "ab", "B ", "abc", "AbcA", "needle", "NEEDLE", "hot needle", "absent", "zq", "😀", "a😀", "STRASSE", "\u0000",
                "l\u0000m", "xxxxneedle", "no id"]
    scan = lambda p: F.coalesce(F.contains(F.upper("text"), F.upper(F.lit(p))), F.lit(False))
    for p in patterns:
        want = sorted(r[0] for r in df.where(scan(p)).select("row").collect())
        assert sorted(r[0] for r in K.search(df, "id", "text", path, p).select("row").collect()) == want, repr(p)


def test_the_gram_is_pushed_down_and_candidates_are_few(spark, table):
    df, path = table
    ids = K.candidates(spark, path, "xneedle")
    assert ids.count() == 1
    assert "In(gram" in ids._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram" in K.candidates(spark, path, "zq")._jdf.queryExecution().executedPlan().toString()
    assert K.candidates(spark, path, "absent gram").count() == 0


def test_empty_table(spark, table):
    df, _ = table
    path = tempfile.mkdtemp(prefix="panelkit-grams-")
    none = df.limit(0)
    K.build_index(none, "id", "text", path, 2)
    assert all(K.search(none, "id", "text", path, p).count() == 0 for p in ("", "a", "abc", "abcd"))


def test_files_follow_the_letters(spark, monkeypatch):
    """A file, and the task that sorts it, holds no more of a larger table."""
    import glob
    monkeypatch.setattr(K, "FILE_LETTERS", 50)
    path = tempfile.mkdtemp(prefix="panelkit-grams-")
    df = spark.createDataFrame([(i, f"text {i % 37} of {i}") for i in range(100)] + [(3, "text 3 of 3"), (7, None)], "id long, text string")
    K.build_index(df, "id", "text", path)
    files = glob.glob(f"{path}/postings/*.parquet")
    assert len(files) > 20
    got = spark.read.parquet(f"{path}/postings")
    assert got.count() == got.distinct().count() == sum(len({(f"text {i % 37} of {i}".upper() + "\0\0")[j:j + 3] for j in range(len(f"text {i % 37} of {i}"))}) for i in range(100))
    assert sorted(r["id"] for r in K.search(df, "id", "text", path, "36 OF").select("id").distinct().collect()) == [36, 73]
