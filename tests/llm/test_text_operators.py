import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from panelkit.llm import bpe, quality, simhash
from panelkit.llm.common import documents
from panelkit.llm.queries import tokenizer_path
from tests.llm.fixtures import SF, SCHEMA, empty, rows, tricky


# --- BPE ---------------------------------------------------------------------------------

def _reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_words_equal_the_library():
    tok, v = _reference_tokenizer(), bpe.vocabulary(tokenizer_path())
    rnd = random.Random(1)
    pools = ["abc", "aaab", "the quick'll don't I'm 123 4", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　",
             "éÈñß漢字かな한글🙂👩‍👩‍👧 ́ͅ²Ⅷ٣", "<|endoftext|> ", "#$%&*|!?.,"]
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b"]
    for _ in range(3000):
        pool = rnd.choice(pools) + rnd.choice(pools)
        texts.append("".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 40))))
    codec = bpe.Codec(v)
    for text, words in zip(texts, codec.encode(texts)):
        ids = bpe.ids_of(words)
        assert ids == tok.encode(text, add_special_tokens=False).ids, repr(text)
        assert bpe.decoded(words) == tok.decode(ids, skip_special_tokens=False) == text


def test_bpe_query_equals_the_library(spark):
    tok = _reference_tokenizer()
    for docs in (documents(spark, SF), tricky(spark)):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            back = tok.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(back.encode()).hexdigest()))
        got = [tuple(r) for r in bpe.bpe(docs, tokenizer_path(), digests=True).collect()]
        assert Counter(got) == Counter(want)


def test_bpe_outputs(spark):
    out = bpe.bpe(tricky(spark), tokenizer_path(), carry=True).collect()
    assert all((r.row.text or "") == r.decoded for r in out)
    assert bpe.bpe(empty(spark), tokenizer_path(), digests=True).count() == 0


# --- SimHash -----------------------------------------------------------------------------

def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps):
    """Smallest id reachable over links of 3 or fewer bits, by brute force."""
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            r = find(f)
            least[r] = min(least.get(r, d), d)
    return sorted([(d, f"{f:016x}", least.get(find(f))) for d, f in fps], key=repr)


@pytest.mark.parametrize("file_rows", [64, 1])
def test_simhash_brute_force(spark, file_rows):
    """Both ways of linking: pairs within small files, and centres for large ones."""
    for docs in (documents(spark, SF), tricky(spark)):
        fps = [(r.doc_id, _fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        got = simhash.near_dedup(docs, file_rows=file_rows).collect()
        assert sorted([tuple(r) for r in got], key=repr) == _components(fps)


@pytest.mark.parametrize("file_rows", [64, 2])
def test_simhash_links_planted_fingerprints(spark, file_rows):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for i in rnd.sample(range(64), rnd.randrange(1, 6)):
                x ^= 1 << i
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    from panelkit.llm.common import connected
    got = {r.node: r.root for r in connected(simhash.links(df, file_rows=file_rows)).collect()}
    want = _components([(i, f) for i, f in enumerate(fps)])
    mine = Counter(got.get(simhash._signed(f), simhash._signed(f)) for f in fps)
    assert sorted(mine.values()) == sorted(Counter(c for _, _, c in want).values())


def test_simhash_centres_are_not_broadcast(spark):
    """What a hot fingerprint is exploded to is not sent to the driver, however small its table is taken to be."""
    rnd = random.Random(7)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(5))) for _ in range(60)})
    hot = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = simhash.centre_links(hot)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {frozenset((r.a, r.b)) for r in edges.collect()}
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 3 for a, b in map(tuple, got))
    root = {simhash._signed(f): simhash._signed(f) for f in fps}
    for a, b in map(tuple, got):
        x, y = root[a], root[b]
        root = {k: y if v == x else v for k, v in root.items()}
    want = Counter(c for _, _, c in _components([(i, f) for i, f in enumerate(fps)]))
    assert sorted(Counter(root.values()).values()) == sorted(want.values())


def test_simhash_keeps_one_row_of_each_group(spark):
    got = simhash.near_dedup(tricky(spark), carry=True).collect()
    assert len(got) == len(rows())
    assert sum(r.kept for r in got) == len({r.component_id for r in got})
    assert simhash.near_dedup(empty(spark)).count() == 0


def test_simhash_spark_hash_is_the_standard_one(spark):
    """The shingle hash is XXH64 with seed 42, which Spark's xxhash64 gives too."""
    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


# --- quality rules -------------------------------------------------------------------------

def _stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(wins).items() if n > 1}
    cover = {i + j for i, w in enumerate(wins) if w in often for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def test_quality_statistics_brute_force(spark):
    for docs in (documents(spark, SF), tricky(spark)):
        data = docs.select("doc_id", "text").collect()
        got = quality.statistics(docs).select("doc_id", *quality.COUNTS).collect()
        assert Counter(map(tuple, got)) == Counter((r.doc_id, *_stats(r.text)) for r in data)


def test_quality_rules_held_out(spark):
    """Learned on half of the labels, the list finds the bad rows of the other half and keeps the good ones."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality.quality_rules(documents(spark, sf), fit).join(held, "doc_id").collect()
    bad = [r for r in out if r.quality == 0]
    good = [r for r in out if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_quality_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality_rules(tricky(spark), none, carry=True).collect()
    assert len(out) == len(rows())
    for r in out:
        n, *_, rep = _stats(r.row.text)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and r.kept == (not r.base_failed)
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert quality.quality_rules(tricky(spark), nulls).count() >= len(rows())
    assert quality.quality_rules(empty(spark), none).count() == 0
    assert SCHEMA.fieldNames()[0] == "doc_id"
