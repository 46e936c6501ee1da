import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import langid
from panelkit.llm.common import documents
from tests.llm.fixtures import empty, rows, tricky

LETTERS = langid.letters()


def test_held_out_accuracy_and_rejection(spark):
    """A model that has seen no held-out row names at least 98 % of them rightly; the
    share of right ones among the accepted is at least as high."""
    docs = documents(spark, "/root/testdata/sf0.1")
    out = langid.held_out_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = [r.lang_pred == r.lang for r in held]
    taken = [r.lang_pred == r.lang for r in held if not r.rejected]
    assert len(held) > 1500 and np.mean(right) >= 0.98
    assert len(taken) > 0.95 * len(held) and np.mean(taken) >= max(0.99, np.mean(right))
    assert all(0 <= r.score <= 1 for r in out)


def test_only_the_text_enters(spark):
    """Other languages, sources and ids of the rows that are predicted change nothing."""
    docs = documents(spark, "/root/testdata/sf0.001")
    model = langid.train(docs)
    a = langid.identify(docs, model).select("lang_pred", "score")
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 7})
    b = langid.identify(moved, model).select("lang_pred", "score")
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("text", ["a", "Ab c", "x-ÿz, qu'é 12 three", "  doppelt  gemoppelt ", "日本 語", "Straße İx", "a1b2", "\ud800q"])
def test_subwords_by_hand(text):
    """Runs of 1 to 4 characters within a word, its edges a space."""
    def slot(gram):
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for ch in gram:
            h = (h ^ ord(ch)) * 0x01000193 & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 19
    want = np.zeros(langid.BUCKETS, int)
    plain = "".join(ch if ch.isalpha() else " " for ch in f" {text.lower()} ")
    for n in langid.SIZES:
        for i in range(len(plain) - n + 1):
            g = plain[i: i + n]
            if g.strip() and " " not in (g[1:-1] if n > 2 else "") and (n > 1 or g != " "):
                want[slot(g)] += 1
    assert (langid.subword_counts(text, LETTERS) == want).all()


def test_no_letters_no_subwords():
    assert all(langid.subword_counts(t, LETTERS) is None for t in (None, "", " ", "12 %$", "²½_"))


def test_calibration_by_brute_force():
    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 3, 300)
    z = rnd.normal(size=(300, 3))
    z[np.arange(300), y] += 1.5
    t, reject = langid.calibrate(z * 4, y, 0.9)
    assert 2.5 < t < 8  # logits four times too large
    p = langid.softmax(z * 4 / t)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    fits = [s for s in score if right[score >= s].mean() >= 0.9]
    assert reject == min(fits)


def test_sample_is_bounded_and_without_copies(spark):
    docs = spark.createDataFrame([(i, f"wort nummer {i % 40}", "de" if i % 4 else "nl") for i in range(400)], "doc_id long, text string, lang string")
    got = langid.labelled_sample(docs, F.lit(True), "doc_id", "text", "lang", 30).collect()
    assert len(got) == 25 and len({(r.lang, r.text) for r in got}) == 25  # nl has ten texts only
    with pytest.raises(ValueError):
        langid.labelled_sample(docs.withColumn("lang", F.expr("concat('l', doc_id + 200 * (doc_id % 3))")).union(
            spark.range(600).selectExpr("id", "concat('t', id)", "concat('m', id)")), F.lit(True), "doc_id", "text", "lang", 30)


def test_tricky_rows(spark):
    out = langid.identify(tricky(spark), langid.train(tricky(spark)), carry=True).collect()
    assert len(out) == len(rows())
    for r in out:
        letter = any(ch.isalpha() for ch in r.row["text"] or "")
        assert (r.lang_pred, r.score) == (("en", 1.0) if letter else ("und", 0.0))  # one language is learned
        assert r.rejected == (not letter) and r.lang == r.lang_pred


def test_nothing_learned_and_empty_table(spark):
    model = langid.train(tricky(spark).where("lang IS NULL"))
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(tricky(spark), model).collect()} == {("und", 0.0, True)}
    assert langid.held_out_report(empty(spark)).count() == 0
