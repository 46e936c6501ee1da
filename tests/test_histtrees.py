"""Histogram ensembles against plain learners, and their independence of layout."""
import math
import tempfile

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from panelkit.plans import histtrees as H

COLS = ["a", "b", "c"]


def table(spark, n=240, classes=3, seed=3):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(size=(n, 3)), 1)
    y = (x[:, 0] + rnd.normal(size=n) > 0).astype(int) + (x[:, 1] > 0.5) * (classes > 2)
    x[rnd.random((n, 3)) < 0.05] = np.nan
    rows = [(i, *[float(v) for v in r], int(k), i % 4) for i, (r, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int"), x, y


def plain_boosting(x, y, classes, rounds, depth, rate, cuts):
    """The same learner by lists of rows and direct sums, without histograms."""
    n = len(y)
    z = np.repeat(np.log(np.bincount(y, minlength=classes) / n)[None], n, 0)

    def bin_of(j, v):
        return 10 ** 6 if math.isnan(v) else sum(c < v for c in cuts[j])
    b = [[bin_of(j, x[i, j]) for j in range(x.shape[1])] for i in range(n)]
    most = max(map(len, cuts)) + 2
    for _ in range(rounds):
        p = H.softmax(z)
        step = np.zeros_like(z)
        for k in range(classes):
            g, h = (y == k) - p[:, k], p[:, k] * (1 - p[:, k])

            def grow(rows, left):
                whole = sum(g[rows]) ** 2 / len(rows)
                best = (1e-9, None)
                for j in range(x.shape[1]) if left else ():
                    for c in range(most):
                        lo = [i for i in rows if b[i][j] <= c]
                        hi = [i for i in rows if b[i][j] > c]
                        if lo and hi:
                            gain = sum(g[lo]) ** 2 / len(lo) + sum(g[hi]) ** 2 / len(hi) - whole
                            if gain > best[0] + 1e-7:
                                best = (gain, (lo, hi))
                if best[1] is None:
                    step[rows, k] = rate * (classes - 1) / classes * sum(g[rows]) / sum(h[rows])
                else:
                    for part in best[1]:
                        grow(part, left - 1)
            grow(list(range(n)), depth)
        z = z + step
    return H.softmax(z)


def probabilities(model, df):
    out = model.transform(VectorAssembler(inputCols=COLS, outputCol="features", handleInvalid="keep").transform(df))
    return np.array([r["p"] for r in out.select("id", vector_to_array("probability").alias("p")).orderBy("id").collect()])


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_equals_a_plain_booster(spark, classes):
    df, x, y = table(spark, 90, classes)
    m = H.fit_boosting(df, COLS, "y", classes, key=["id"], rounds=4, depth=3, rate=0.3, max_bins=8)[0]
    cuts = H.cut_points(df, COLS, 8)
    for j in range(3):
        v = np.sort(x[:, j][~np.isnan(x[:, j])])
        assert cuts[j] == sorted({float(v[max(1, math.ceil(i / 8 * len(v) - 1e-9)) - 1]) for i in range(1, 8)})
    got, want = probabilities(m, df), plain_boosting(x, y, classes, 4, 3, 0.3, cuts)
    assert np.abs(got - want).max() < 1e-5 and np.abs(got.sum(1) - 1).max() < 1e-12


def test_layouts_and_ways_give_the_same_trees(spark, monkeypatch):
    """One task, or jobs over 1 or 5 partitions with rounds folded in early; folds too."""
    monkeypatch.setattr(H, "CHECKPOINT", 2)
    monkeypatch.setattr(H, "BLOCK_ROWS", 60)
    df, _, _ = table(spark)
    spec = {"key": ["id"], "fold": "fold", "fits": [None, 0, 2], "max_bins": 16}
    states = []
    for d, n in ((df, 10 ** 9), (df.repartition(5, "a"), 0), (df.coalesce(1), 10 ** 9)):
        ms = H.fit_boosting(d, COLS, "y", 3, rounds=6, depth=3, rate=0.2, subsample=0.7, one_task_rows=n, **spec)
        ms += H.fit_forest(d, COLS, "y", 3, trees=7, depth=4, min_leaf=2, one_task_rows=n, **spec)
        states.append([m.getOrDefault("state") for m in ms])
    assert states[0] == states[1] == states[2] and len(set(states[0])) == 6


def test_a_fold_fit_does_not_see_its_fold(spark):
    from pyspark.sql import functions as F
    df, _, _ = table(spark)
    changed = df.withColumn("y", F.when(F.col("fold") == 1, 2 - F.col("y")).otherwise(F.col("y")))
    # the cuts are the same, as features are; only labels of fold 1 differ
    for fit, kw in ((H.fit_boosting, {"rounds": 3, "depth": 2, "rate": 0.2}), (H.fit_forest, {"trees": 4, "depth": 3})):
        a, b = (fit(d, COLS, "y", 3, key=["id"], fold="fold", fits=[1, None], **kw) for d in (df, changed))
        assert a[0].getOrDefault("state") == b[0].getOrDefault("state") and a[1].getOrDefault("state") != b[1].getOrDefault("state")


def test_forest_learns_and_leaves_are_shares(spark):
    df, _, y = table(spark, 400)
    m = H.fit_forest(df, COLS, "y", 3, key=["id"], trees=25, depth=5, min_leaf=3)[0]
    p = probabilities(m, df)
    assert np.abs(p.sum(1) - 1).max() < 1e-12 and (p.argmax(1) == y).mean() > 0.8
    assert abs(sum(m.featureImportances) - 1) < 1e-12


def test_bag_weights_are_poisson_and_follow_the_key():
    keys = np.random.default_rng(0).integers(0, 2 ** 63, 200_000).astype(np.uint64)
    w = H.bag_weight(keys, 42, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert (H.bag_weight(keys[::-1], 42, 7)[::-1] == w).all()
    other = H.bag_weight(keys, 42, 8)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.01
    assert abs(H.in_subsample(keys, 1, 3, 0.8).mean() - 0.8) < 0.005


def test_class_weights_count(spark):
    from pyspark.sql import functions as F
    df, _, y = table(spark, 300, 2)
    w = df.withColumn("w", F.when(F.col("y") == 1, 50.0).otherwise(1.0))
    p, q = (probabilities(H.fit_forest(d, COLS, "y", 2, key=["id"], trees=10, depth=3, weight=c)[0], df) for d, c in ((df, None), (w, "w")))
    assert q[:, 1].mean() > p[:, 1].mean() + 0.2


def test_bound_saving_and_degenerate_tables(spark):
    df, _, _ = table(spark, 200)
    m = H.fit_boosting(df, COLS, "y", 3, key=["id"], rounds=2, depth=2, rate=0.5, max_rows=50)[0]
    n = H.fit_boosting(df.repartition(4), COLS, "y", 3, key=["id"], rounds=2, depth=2, rate=0.5, max_rows=50)[0]
    assert m.getOrDefault("state") == n.getOrDefault("state")
    d = tempfile.mkdtemp(prefix="panelkit-trees-")
    m.write().overwrite().save(d + "/m")
    assert (probabilities(H.HistogramTreesModel.load(d + "/m"), df) == probabilities(m, df)).all()
    none = df.selectExpr("id", "a", "b", "c", "CAST(NULL AS int) AS y", "fold")
    for k in (1, 3):
        e = H.fit_boosting(none, COLS, "y", k, key=["id"], rounds=2, depth=2, rate=0.5)[0]
        assert np.abs(probabilities(e, df).sum(1) - 1).max() < 1e-12
    one = H.fit_forest(df.withColumn("y", df.y * 0), COLS, "y", 1, key=["id"], trees=2, depth=2)[0]
    assert (probabilities(one, df) == 1).all()


def test_chunks_are_bounded_and_do_not_change_the_trees(spark, monkeypatch):
    """A task works on a bounded number of rows at a time, whatever its partition holds."""
    from pyspark.sql import functions as F
    df, _, _ = table(spark)
    spec = {"key": ["id"], "fold": "fold", "fits": [None, 1], "max_bins": 16}

    def states(**kw):
        ms = H.fit_boosting(df, COLS, "y", 3, rounds=3, depth=3, rate=0.2, subsample=0.7, **kw, **spec)
        ms += H.fit_forest(df, COLS, "y", 3, trees=5, depth=4, min_leaf=2, weight="a1", **kw, **spec)
        return [m.getOrDefault("state") for m in ms]
    df = df.withColumn("a1", F.lit(0.75) + F.col("y") / 4)
    cuts = [[-1.0, -0.5, 0.0, 0.5, 1.0]] * 3
    monkeypatch.setattr(H, "cut_points", lambda *_: cuts)
    whole = states()
    monkeypatch.setattr(H, "CHUNK_ROWS", 20)
    assert states() == whole and states(one_task_rows=0, block_rows=90) == whole
    blocks, n = H._packed(df.coalesce(1), COLS, cuts, 20, F.xxhash64("id"), F.col("y"), F.lit(1.0), F.lit(-1), 0, 10 ** 9, 0)
    sizes = blocks.map(lambda b: len(b["y"])).collect()
    assert n == sum(sizes) == 240 and max(sizes) < 40


def test_scores_of_a_round_are_kept_for_the_next(spark, monkeypatch):
    """No job of a round starts again from the first round's trees."""
    df, _, _ = table(spark)
    sent = []
    monkeypatch.setattr(H, "cut_points", lambda *_: [[-1.0, 0.0, 1.0]] * 3)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append(v))
    H.fit_boosting(df, COLS, "y", 3, key=["id"], rounds=3, depth=2, rate=0.2, one_task_rows=0)
    assert sent == []


def test_layouts_differ_beyond_one_task(spark):
    from pyspark.sql import functions as F
    df, _, _ = table(spark)
    cuts = [[-1.0, 0.0, 1.0]] * 3
    parts = [H._packed(df, COLS, cuts, 10, F.xxhash64("id"), F.col("y"), F.lit(1.0), F.lit(-1), 0, 0, rows)[0].getNumPartitions() for rows in (0, 80, 50)]
    assert parts == [2, 3, 5]


def test_a_fit_keeps_no_stored_rounds(spark, monkeypatch):
    """Each stored state of a long fit goes when the next one is there, and the last one at the end."""
    import pathlib

    from panelkit.session import drop_stores, ensure_checkpoint_dir
    df, _, _ = table(spark)
    monkeypatch.setattr(H, "CHECKPOINT", 2)
    monkeypatch.setattr(H, "cut_points", lambda *a: [[-0.5, 0.0, 0.5]] * 3)
    dropped = []
    monkeypatch.setattr(H, "drop_stores", lambda s, paths: (dropped.append(list(paths)), drop_stores(s, paths)))
    root = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("*/rdd-*"))
    H.fit_boosting(df, COLS, "y", 3, key=["id"], rounds=8, depth=2, rate=0.1, one_task_rows=0, block_rows=100)
    assert set(root.glob("*/rdd-*")) <= before and sum(map(len, dropped)) >= 3


def test_the_split_keeps_only_its_parts(spark):
    import os

    from panelkit.plans import models as M
    from panelkit.session import recorded_stores
    data = spark.createDataFrame([(i, 2000 + i % 3, float(i % 7), int(i % 4 == 0)) for i in range(200)], "entity_id long, yr int, a double, label int")
    with recorded_stores() as made:
        train, test = M.prepare_split(data, ["entity_id", "yr"])
    assert sum(os.path.exists(p.removeprefix("file:")) for p in made) == 2 < len(made)
    assert train.count() + test.count() == 200
