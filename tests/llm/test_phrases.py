import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelkit.llm import phrases
from tests.llm.fixtures import SCHEMA, empty, rows, tricky

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(data, min_count, top=2000, inside=50):
    f, words = {}, Counter()
    for lang, text in data:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in (1, 2, 3):
                c.update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: n for p, n in c.items() if len(p) > 1 and n >= min_count}
        kept = []
        for p, a in cands.items():
            if any(100 * n >= inside * a for q, n in cands.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts():
    rnd = random.Random(8)
    vocab = ["the", "The", "of", "a", "ÉT", "ét", "x", "naïve", "new", "york", "\x1c", "\xa0", "u v"]
    def one():
        return "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "? ", "\r\n"]) for _ in range(rnd.randrange(60)))
    return [(i, one(), rnd.choice(["en", "en", "en", "de", None, "und"])) for i in range(120)] + [(1, "new york city!", "fr")] * 3


@pytest.mark.parametrize("sample,low,bits", [(0.25, 2, 1 << 20), (0.0, 1, 1 << 15), (1.0, 1, 1 << 15), (0.5, 4, 1 << 20)])
def test_equals_brute_force_whatever_the_sample(spark, sample, low, bits, monkeypatch):
    """No proposal at all, all of them, some: border failures are counted by further passes."""
    monkeypatch.setattr(phrases, "MIN_BITS", 1 << 15)
    data = texts()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    got = phrases.collocations(docs, min_count=3, sample=sample, sample_min=low, max_bits=bits, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([(v, t) for _, t, v in data], 3, top=40)
    passes = phrases.frequent_phrases(docs, min_count=3, sample=sample, sample_min=low, max_bits=bits)[2]
    assert not any(passes[-1].values()) and len(passes) <= 3
    if not sample:
        assert [any(p.values()) for p in passes] == [True, True, False]  # words, then pairs, then closed


def test_full_bitmaps_count_everything_once(spark):
    """Bitmaps with all bits set are slower, not wrong."""
    t = pa.array([b"a b c a b. c a b c"], pa.binary())
    full = [phrases.Bitmap(np.full(4096, 255, np.uint8))] * 2
    count = {}
    for b in phrases.chunk_counts("en", t, full, None):
        count.update({(len(r["phrase"].split()), r["phrase"]): r["n"] for r in b.to_pylist()})
    assert count == {(1, b"a"): 3, (1, b"b"): 3, (1, b"c"): 3, (2, b"a b"): 3, (2, b"b c"): 2, (2, b"c a"): 2, (3, b"a b c"): 2,
                     (3, b"b c a"): 1, (3, b"c a b"): 2}
    assert list(phrases.chunk_counts("en", t, full, full)) == [] or all(b.num_rows == 0 for b in phrases.chunk_counts("en", t, full, full))


def test_chunks_and_wide_numbers(spark, monkeypatch):
    """Counts do not depend on how texts are cut into chunks."""
    data = texts()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").coalesce(1)
    monkeypatch.setattr(phrases, "CHUNK", 100)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50, "text": [b"x" * (i * 7 % 130) for i in range(50)]})
    cut = list(phrases.chunks(iter([batch, batch]), 100))
    assert pa.concat_tables(cut).to_batches() and pa.concat_tables(cut)["text"].to_pylist() == batch["text"].to_pylist() * 2
    assert all(t.num_rows == 1 or t["text"].nbytes < 1000 for t in cut) and len(cut) > 50
    assert sorted(map(tuple, phrases.collocations(docs, min_count=3).collect())) == brute([(v, t) for _, t, v in data], 3)


def test_score_is_exact_beyond_64_bits(spark):
    a, left, right = 9_999_999_999_991, 10_000_000_000_007, 99_999_999_999_989
    df = spark.createDataFrame([(a, left, right), (a, a, a)], "a long, l long, r long")
    assert [r[0] for r in df.selectExpr(phrases.SCORE).collect()] == [10 ** 6 * a * a // (left * right), 10 ** 6]


def test_tricky_rows_and_empty_table(spark):
    """Null, empty and very long texts, repeated rows, clashing columns, no rows."""
    data = [(r[2], r[1]) for r in rows()]
    got = phrases.collocations(tricky(spark), min_count=2, top=10 ** 6)
    assert sorted(map(tuple, got.collect())) == brute(data, 2, top=10 ** 6)
    assert len(SCHEMA) > 5 and phrases.collocations(empty(spark)).count() == 0
