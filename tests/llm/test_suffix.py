import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import suffix
from panelkit.llm.common import documents
from tests.llm.fixtures import SCHEMA, SF, empty, tricky


def _brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _compare(docs, **kw):
    data = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(data, _brute([(r.text or "").encode() for r in data], kw.get("length", 400)))]
    got = suffix.suffix_dedup(docs, **kw)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == Counter(want)


def test_generated_documents(spark):
    _compare(documents(spark, SF))


@pytest.mark.parametrize("group_rows", [10_000, 2])
def test_patchwork_of_passages(spark, group_rows):
    """Passages cut and joined at random, edited copies, runs and periods; both ways of comparing contexts."""
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(20, 130))) for _ in range(12)]
    texts = []
    for _ in range(120):
        t = "".join(rnd.choice(passages)[rnd.randrange(8):] for _ in range(rnd.randrange(1, 5)))
        if rnd.random() < 0.3 and t:
            i = rnd.randrange(len(t))
            t = t[:i] + "#" + t[i + 1:]
        texts.append(t)
    texts += ["a" * 200, "ab" * 90, "x", "", None, texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, t in enumerate(texts)], SCHEMA).repartition(6)
    _compare(docs, length=50, reach=20, batches=5, group_rows=group_rows)


def test_tricky_rows_and_outputs(spark):
    docs = tricky(spark)
    _compare(docs, length=60, reach=30)
    out = suffix.suffix_dedup(docs, length=60, reach=30, carry=True).collect()
    for r in out:
        text, kept, at = (r.row.text or "").encode(), b"", 0
        for s in r.spans:
            kept, at = kept + text[at:s.start], s.end
        assert kept + text[at:] == bytes(r.kept_text) and hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256
    assert suffix.suffix_dedup(empty(spark)).count() == 0


def test_every_window_has_the_same_anchor_everywhere():
    rnd = random.Random(2)
    window = bytes(rnd.randrange(97, 103) for _ in range(100))
    places = []
    for _ in range(20):
        left = bytes(rnd.randrange(97, 103) for _ in range(rnd.randrange(0, 300)))
        at = suffix.anchors(left + window + left[:50], 40)
        places.append({int(a) - len(left) for a in at if 0 <= a - len(left) < 40})
    assert set.intersection(*places)


def test_long_text_is_cut_with_overlap(monkeypatch):
    rnd = np.random.default_rng(4)
    text = bytes(rnd.integers(97, 100, 5000, dtype=np.uint8))
    whole = suffix.suffix_rows([text, b"", text[:1000]], 400, 160)
    monkeypatch.setattr(suffix, "_SEGMENT", 700)
    cut = suffix.suffix_rows([text, b"", text[:1000]], 400, 160)
    a = set(zip(whole[0].tolist(), whole[1].tolist()))
    b = set(zip(cut[0].tolist(), cut[1].tolist()))
    # every window keeps its own anchor, whatever the cuts
    for s in range(len(text) - 400):
        assert any((0, x) in a and (0, x) in b for x in range(s, s + 160))


def test_levels_merge_geometrically(spark):
    levels = suffix.Levels(spark, 3)
    ranks = []
    for i in range(5):
        found = levels.add(spark.range(i, i + 10).selectExpr("id AS core"))
        assert {r.core for r in found.collect()} == (set(range(i, i + 9)) if i else set())
        ranks.append([r for r, _ in levels.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]]
    total = {r.core: r.n for _, t in levels.levels[:1] for r in spark.table(t).collect()}
    assert total == Counter(j for i in range(4) for j in range(i, i + 10))
    levels.close()
