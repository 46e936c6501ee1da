"""Operator goldens and properties on hand-made frames (FIXTURES A6)."""
import random

import pytest
from pyspark.sql import functions as F

from panelkit.operators import aggregates as A
from panelkit.operators import evaluation as E
from panelkit.operators import reshape as U
from panelkit.operators import sampling as SM
from panelkit.operators import stats as S
from panelkit.operators import windows as W


def test_share_denominator_counts_null_category(spark):
    # A NULL tier counts in the yearly total, shares need not sum to 100
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, None), (1, "B")], "yr int, tier string")
    out = {r["tier"]: (r["n"], r["total"], r["pct"]) for r in A.group_share(df, "yr", "tier").collect()}
    assert out == {"A": (2, 4, 50.0), "B": (1, 4, 25.0)}


def test_bround_half_even(spark):
    # 1/8 → 12.5 stays; 1/400·100 = 0.25 → 0.2 (half-even)
    df = spark.createDataFrame([(1, "a")] + [(1, "b")] * 399, "yr int, tier string")
    out = {r["tier"]: r["pct"] for r in A.group_share(df, "yr", "tier").collect()}
    assert out["a"] == 0.2


def test_one_row_group_std_is_null_and_median_exact(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (2, 2.0), (2, 3.0), (2, 4.0)], "yr int, x double")
    out = {r["yr"]: r for r in A.year_stats(df, "yr", "x").collect()}
    assert out[1]["std"] is None
    assert out[2]["median"] == 2.5
    q = df.filter("yr = 2").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()["q"]
    assert q == [1.75, 3.25]


def test_group_by_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0)], "k string, x double")
    assert [r["k"] for r in A.group_means(df, ["k"], ["x"]).collect()] == ["a"]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 4.0, 4.0001, 6.0, 8.0, 10.0, None]], "x double")
    labs = [r["b"] for r in df.select(S.right_closed_bins("x", [0, 4, 6, 8, 10]).alias("b")).collect()]
    assert labs == [None, "(0, 4]", "(4, 6]", "(4, 6]", "(6, 8]", "(8, 10]", None]


def test_topk_ties_keep_first_rows(spark):
    from panelkit.operators.topk import top_k
    df = spark.createDataFrame([(i, 1.0) for i in range(5)] + [(9, 0.5)], "row_id int, score double")
    assert [r["row_id"] for r in top_k(df, "score", 3, "row_id").collect()] == [0, 1, 2]


def test_auc_with_ties_is_five_sixths(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.9, 1), (0.1, 0), (0.5, 1)], "score double, label int")
    assert abs(E.auc(df, ranges=2).first()["auc"] - 5 / 6) < 1e-12


def test_auc_matches_brute_force_and_is_rank_invariant(spark):
    rnd = random.Random(7)
    data = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(data, "score double, label int")
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = E.auc(df, ranges=7).first()["auc"]
    assert abs(got - brute) < 1e-12
    mono = df.withColumn("score", F.col("score") * 3 + 1)
    assert abs(E.auc(mono, ranges=5).first()["auc"] - got) < 1e-12


def test_prefix_sums_match_running_total(spark):
    rnd = random.Random(3)
    data = [(float(i), rnd.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "k double, v long")
    out = {r["k"]: r["cum_v"] for r in E.ordered_prefix_sums(df, "k", ["v"], ranges=9).collect()}
    run = 0
    for k, v in data:
        run += v
        assert out[k] == run


def test_yoy_from_history_map(spark):
    df = spark.createDataFrame([("a", {2022: 6.1, 2023: 6.8, 2024: 7.52})], "id string, h map<int,double>")
    long = U.explode_history(df, "h", "yr", "inde", keep=["id"])
    d = [r["d_inde"] for r in W.yoy_delta(long, "id", "yr", ["inde"]).orderBy("yr").collect()]
    assert d == [None, 0.7, 0.72]


def test_wide_to_long_roundtrip(spark):
    df = spark.createDataFrame([(1, 5.0, None, 7.0), (2, None, 3.0, None)], "id int, x_2020 double, x_2021 double, y_2020 double")
    long = U.wide_to_long(df, ["id"], ["x", "y"], [2020, 2021], "yr", anchor="x")
    got = sorted((r["id"], r["yr"], r["x"], r["y"]) for r in long.collect())
    assert got == [(1, 2020, 5.0, 7.0), (2, 2021, 3.0, None)]


def test_stratified_folds_sizes_differ_by_at_most_one(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    f = SM.stratified_folds(df, "label", ["id"], 5, buckets=16)
    sizes = {}
    for r in f.groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    for v in sizes.values():
        assert max(v) - min(v) <= 1 and len(v) == 5
    s = SM.stratified_split(df, "label", ["id"], 0.2, buckets=16)
    assert s.count() == 1003


def test_leavers_are_transitions(spark):
    df = spark.createDataFrame([(1, 2000), (1, 2001), (1, 2003), (2, 2001)], "e int, yr int")
    t = {(r["e"], r["yr"]): r["left"] for r in W.transitions(df, "e", "yr", 2000, 2002).collect()}
    assert t == {(1, 2000): 0, (1, 2001): 1, (2, 2001): 1}
    lv = {(r["e"], r["yr"]) for r in W.leavers(df, "e", "yr", 2000, 2002).collect()}
    assert lv == {k for k, v in t.items() if v == 1}


def test_streak_gaps_and_islands(spark):
    ev = spark.createDataFrame([(1, f"2024-01-0{d} 10:00:00") for d in (1, 2, 3, 5)] + [(2, "2024-01-01 00:00:00")],
                               "u int, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = {r["u"]: (r["longest"], r["reached"]) for r in W.streaks(ev, "u", "ts").collect()}
    assert out == {1: (3, True), 2: (1, False)}


def test_threshold_calibration_picks_first_max(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.1), (1, 1, 0.8), (1, 0, 0.2)], "fold int, label int, score double")
    grid = E.threshold_grid(0.45, 0.80)
    assert len(grid) == 22
    best = E.best_threshold(E.threshold_f1(df, grid)).first()
    assert best["threshold"] == grid[0] and best["mean_f1"] == 1.0


def test_density_integrates_to_about_one(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([("g", rnd.gauss(5, 1)) for _ in range(500)], "g string, x double")
    d = S.density_grid(df, "x", "g", points=200).orderBy("i").collect()
    step = d[1]["x"] - d[0]["x"]
    assert 0.85 < sum(r["density"] for r in d) * step < 1.05


def test_box_whiskers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "g string, x double")
    r = S.box_summary(df, "x", "g").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_hi"], r["outliers"]) == (2.0, 3.0, 4.0, 4.0, 1)


def test_keyed_auc_with_hot_key_matches_brute_force(spark):
    rnd = random.Random(11)
    data = [("hot" if i % 10 else f"k{i % 3}", round(rnd.random(), 2), rnd.randint(0, 1)) for i in range(600)]
    df = spark.createDataFrame(data, "g string, score double, label int")
    got = {r["g"]: r["auc"] for r in E.auc(df, keys=["g"], ranges=6).collect()}
    for g in got:
        pos = [s for k, s, y in data if k == g and y == 1]
        neg = [s for k, s, y in data if k == g and y == 0]
        brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[g] - brute) < 1e-12


def test_first_seen_code_order(spark):
    df = spark.createDataFrame([(5, "b"), (1, "c"), (3, "a"), (2, "c"), (9, None)], "rid int, cat string")
    assert {r["cat"]: r["code"] for r in W.first_seen_code(df, "cat", "rid").collect()} == {"c": 0, "a": 1, "b": 2}


def test_event_ordinal_hot_user_matches_row_number(spark):
    from pyspark.sql import Window
    from panelkit.plans.progress import event_ordinal
    rnd = random.Random(5)
    rows = [(0 if i % 3 else rnd.randint(1, 4), i, 1_700_000_000 + rnd.randint(0, 10 * 86400)) for i in range(900)]
    ev = spark.createDataFrame(rows, "u int, eid int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["eid"]: r["ordinal"] for r in event_ordinal(ev, "u", "ts", "eid").collect()}
    w = Window.partitionBy("u").orderBy("ts", "eid")
    want = {r["eid"]: r["o"] for r in ev.select("eid", (F.row_number().over(w) - 1).alias("o")).collect()}
    assert got == want


def test_degenerate_inputs_give_null_not_errors(spark):
    one_class = spark.createDataFrame([(0.3, 1), (0.7, 1)], "score double, label int")
    assert E.auc(one_class).first()["auc"] is None
    empty = spark.createDataFrame([], "x double, label int, pred int")
    assert A.null_profile(empty, ["x"]).first()["pct"] is None
    assert E.weighted_f1(empty).first()["weighted_f1"] is None


def test_approximate_quantiles_are_near_the_exact_ones(spark):
    df = spark.range(2000).selectExpr("id % 4 AS yr", "CAST(id * 7919 % 2003 AS double) / 10 AS x")
    for exact in (True, False):
        y = {r["yr"]: r["median"] for r in A.year_stats(df, "yr", "x", exact=exact).collect()}
        b = {r["yr"]: (r["q1"], r["q3"], r["n"]) for r in S.box_summary(df, "x", "yr", exact=exact).collect()}
        c = A.column_stats(df, ["x"], exact=exact).first()["median"]
        if exact:
            want = (y, b, c)
    assert all(abs(want[0][k] - y[k]) < 3 for k in y) and abs(want[2] - c) < 3
    assert all(abs(want[1][k][i] - b[k][i]) < 3 for k in b for i in range(3))


def test_prefix_sums_keep_rows_without_order_or_key(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", None, 10), (None, 1.0, 5), (None, 3.0, 7), ("a", 1.0, 2)], "g string, k double, v long")
    out = {(r["g"], r["k"]): r["cum_v"] for r in E.ordered_prefix_sums(df, "k", ["v"], keys=["g"], ranges=2).collect()}
    assert out == {("a", 1.0): 2, ("a", 2.0): 3, ("a", None): 13, (None, 1.0): 5, (None, 3.0): 12}


def test_event_ordinal_keeps_events_without_time_or_entity(spark):
    """An answer without a time is the entity's last; a missing entity is one entity."""
    import datetime as dt
    from panelkit.plans.progress import event_ordinal, quiz_sessions
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    ev = spark.createDataFrame([(1, 7, t(3)), (2, 7, None), (3, 7, t(1)), (4, None, t(2)), (5, None, None), (6, 7, None)],
                               "event_id long, user_id long, ts timestamp")
    for ranges in (1, 2, 256):
        got = {r["event_id"]: r["ordinal"] for r in event_ordinal(ev, "user_id", "ts", "event_id", ranges=ranges).collect()}
        assert got == {3: 0, 1: 1, 2: 2, 6: 3, 4: 0, 5: 1}
    s = quiz_sessions(ev.withColumn("ok", F.lit(True)), correct="ok").collect()
    assert sorted((r["user_id"] or 0, r["answers"]) for r in s) == [(0, 2), (7, 4)]
