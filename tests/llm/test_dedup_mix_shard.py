import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelkit.llm import curriculum, exact_dedup, shuffle
from panelkit.llm.common import connected, documents
from tests.llm.fixtures import SF, empty, rows, tricky


def _exact(data):
    """(doc_id, keep_id, group_size, sha) of every row, by brute force."""
    groups = defaultdict(list)
    for r in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(g), hashlib.sha256(norm.encode()).hexdigest()) for r in g]
    return groups, sorted(out, key=repr)


@pytest.mark.parametrize("key_bits,bucket_keys", [(64, 4096), (64, 2), (3, 2), (1, 1)])
def test_exact_dedup_brute_force(spark, key_bits, bucket_keys):
    """Also with a hash so short that different texts share keys (chains)."""
    got = exact_dedup.exact_dedup(tricky(spark), key_bits=key_bits, bucket_keys=bucket_keys, carry=True).collect()
    groups, want = _exact(rows())
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == want
    assert sum(r.kept for r in got) == len(groups)
    assert Counter(r.row.uid for r in got) == Counter(r[5] for r in rows())


def test_directory_holds_every_key_once_and_no_full_bucket(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    d = exact_dedup.grow_directory(keys, 16, 64)
    assert d.agg({"n": "max"}).first()[0] <= 16
    assert d.agg({"n": "sum"}).first()[0] == 5000
    assert exact_dedup.locate(keys, d).count() == 5000


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def _targets(sizes):
    """Iterated resharing of the excess, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {s: 0.0 for s in order}, set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("whole", [False, True])
def test_mixing_targets_and_words(spark, whole):
    for docs in (documents(spark, SF), tricky(spark)):
        data = docs.select("doc_id", "text", "source").collect()
        sizes = Counter()
        for r in data:
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        target = _targets(sizes)
        got = curriculum.curriculum_plan(docs, whole=whole, carry=True).collect()
        assert len(got) == len(data)
        taken = Counter()
        for r in got:
            src = r.row.source
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or ""))
            assert r.source_size == sizes[src] and abs(r.target - target[src]) < 1e-6 * max(1, target[src])
            assert 0 <= r.taken <= 2 * r.size
            assert not whole or r.taken in (0, r.size, 2 * r.size)
            assert r.taken == sum(c.words for c in r.copies)
            taken[src] += r.taken
        largest = max(r.size for r in got)
        for s in sizes:
            assert abs(taken[s] - target[s]) <= (largest / 2 if whole else 1)


def test_curriculum_positions(spark):
    """Positions rise along the stream, stay below the demand, and follow the schedules."""
    docs = documents(spark, SF)
    out = curriculum.curriculum_mix(docs).collect()
    pos = [r.position for r in out]
    assert pos == sorted(pos) and pos[0] >= 0
    total = sum({(r.source_size, r.target): r.target for r in out}.values())
    assert pos[-1] <= total + 1
    assert [tuple(r) for r in out] == [tuple(r) for r in curriculum.curriculum_mix(docs).collect()]
    early = {"words": 0, "early": 0}
    order = sorted({r[0] for r in docs.select("source").distinct().collect()})
    plan = curriculum.curriculum_plan(docs, carry=True).collect()
    for r in plan:  # sources of the first schedule (density 1.5 to 0.5) read 62.5 % in the first half
        if order.index(r.row.source) % 3 == 0:
            for c in r.copies:
                early["words"] += c.words
                early["early"] += c.words * (c.time < 0.5)
    assert abs(early["early"] / early["words"] - 0.625) < 0.1


def test_schedule_inverse(spark):
    knots = ((0.0, 0.2), (0.3, 2.0), (1.0, 0.7))
    df = spark.range(101).selectExpr("id / 100D AS u").withColumn("t", curriculum.inverse(knots, curriculum.F.col("u")))
    df = df.withColumn("back", curriculum.integral(knots, curriculum.F.col("t")))
    assert all(abs(r.u - r.back) < 1e-9 for r in df.collect())


def test_mixing_empty(spark):
    assert curriculum.mix_report(empty(spark)).count() == 0


@pytest.mark.parametrize("block_rows", [1_000_000, 7])
def test_sharding_exact_and_gapless(spark, block_rows):
    docs = tricky(spark).repartition(5)
    got = shuffle.hypergeometric_shuffle(docs, 6, block_rows=block_rows).collect()
    assert Counter(r.row for r in got) == Counter(docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_report(spark):
    docs = documents(spark, SF)
    want = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                  for r in docs.select("doc_id", "text").collect())
    got = shuffle.shard_report(docs).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert shuffle.shard_report(empty(spark)).count() == 0
    assert shuffle.shard_report(docs.limit(3)).count() == 3


def test_communication_matrix_law():
    """Row and column sums are exact; cell means follow the hypergeometric law."""
    parts, blocks = [30, 0, 50, 20], [40, 35, 25]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = shuffle.communication_matrix(parts, blocks, seed)
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == blocks
        total += m
    assert np.abs(total / 400 - np.outer(parts, blocks) / 100).max() < 0.6


def test_large_hypergeometric_matches_small_law():
    rng = np.random.default_rng(0)
    big = [shuffle._hypergeometric(rng, 2 * 10 ** 9, 3 * 10 ** 9, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 400) < 4 and 9 < np.std(big) < 22


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
