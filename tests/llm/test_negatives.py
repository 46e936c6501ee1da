import random

import numpy as np
import pytest

from panelkit.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, score string"


@pytest.mark.parametrize("m,k,n,leaf", [(1, 1, 1, 1), (5, 7, 3, 1), (33, 64, 47, 8), (100, 65, 130, 16), (0, 4, 3, 2), (64, 0, 64, 8)])
def test_strassen_equals_the_plain_product(m, k, n, leaf):
    rnd = np.random.default_rng(m + n)
    a, b = rnd.integers(-1000, 1000, (m, k)), rnd.integers(-1000, 1000, (k, n))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_is_exact_though_sums_wrap_around():
    a = np.array([[2 ** 62, 1], [3, -2 ** 62]], np.int64)
    b = np.array([[1, 0], [5, 1]], np.int64)
    want = [[2 ** 62 + 5, 1], [(3 - 5 * 2 ** 62 + 2 ** 63) % 2 ** 64 - 2 ** 63, -2 ** 62]]
    assert negatives.strassen(a, b, 1).tolist() == want


def test_best_of_rows_with_ties():
    s = np.array([[3, 5, 5, 5, 1], [negatives._NONE] * 5, [2, negatives._NONE, 2, 2, 9]], np.int64)
    r, c = negatives.best(s, 2)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 1), (0, 2), (2, 0), (2, 4)]


def brute(rows, n_pos, n_neg, low, high):
    v = [(i, int(y), [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, y, *_ in rows
         if i is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    out = []
    for k, (i, y, e) in enumerate(v):
        if i % 4:
            continue
        s = sorted((-dot(e, f), j, n, z) for n, (j, z, f) in enumerate(v) if n != k)
        for p, j, _, z in [x for x in s if x[3] == y][:n_pos]:
            neg = [x for x in s if x[3] != y and low * -p <= 100 * -x[0] <= high * -p][:n_neg]
            out += [(i, j, r, x[1], -p, -x[0]) for r, x in enumerate(neg, 1)]
    return sorted(out)


def table(n, labels, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([0.0, 0.25, 0.5, 1.0, -0.5, 0.1]) for _ in range(5)], rnd.choice(labels), "u", "s") for i in range(n)]
    rows += [rows[3], rows[4], rows[4]]  # repeated rows, anchors among them
    rows += [(n, None, 1, "u", "s"), (n + 1, [1.0, None], 1, "u", "s"), (n + 2, [1.0, float("nan")], 0, None, None), (None, [1.0] * 5, 1, "", ""),
             (n + 3, [float("inf")], 0, "", ""), (n + 4, [1.0, 1.0], None, "", ""), (4 * n, [], 1, "", ""), (4 * n + 4, [1.0, 2.0], 0, "", "")]
    return rows


@pytest.mark.parametrize("labels,strip", [([0, 1, 2], 7), ([0, 0, 0, 0, 1], 5), ([0, 1], None)])
def test_equals_brute_force(spark, labels, strip):
    """Ties, repeated rows, short and empty vectors, a hot label, many tiles."""
    rows = table(60, labels, len(labels))
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), "vec_id % 4 = 0", n_pos=3, n_neg=4, strip=strip)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 4, 30, 90)


def test_no_rows_one_label_and_huge_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, "true").count() == 0
    one = spark.createDataFrame([(i, [1.0], 1, "", "") for i in range(9)], SCHEMA)
    assert negatives.hard_negatives(one, "true").count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(1, [3e38], 1, "", "")], SCHEMA), "true")
