"""Distributed selection equals sorting."""
import math
import random

import numpy as np
import pytest

from panelkit.operators.quantiles import column_quantiles, exact_quantiles

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def data():
    rnd = random.Random(4)
    rows = [("hot", rnd.gauss(0, 10 ** rnd.randrange(-3, 6))) for _ in range(900)]
    rows += [("ties", float(rnd.randrange(3))) for _ in range(200)] + [("one", 7.5)] + [("two", -1.0), ("two", 2.0)]
    rows += [(None, float(i)) for i in range(10)] + [("none", None), ("none", float("nan")), ("gaps", None), ("gaps", -0.0), ("gaps", 1.0)]
    rows += [("wide", 10.0 ** k) for k in range(-300, 300, 7)] + [("wide", -1.7e308), ("wide", 1.7e308)]
    return rows


def close(a, b):
    return (a is None and b is None) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-300)


@pytest.mark.parametrize("bins", [64, 512])
def test_groups_equal_sorting(spark, bins):
    rows = data() + ([("inf", math.inf), ("inf", -math.inf), ("inf", 1.0)] if bins == 64 else [])
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(df, "x", LEVELS, ["g"], bins=bins).collect()}
    low = {r["g"]: r for r in exact_quantiles(df, "x", LEVELS, ["g"], how="lower", bins=bins).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, r in got.items():
        v = np.sort([x for k, x in rows if k == g and x is not None and not math.isnan(x)])
        assert r["n"] == len(v)
        if g == "inf":
            assert r["quantiles"][3] == 1.0 and low[g]["quantiles"] == [-math.inf, -math.inf, -math.inf, 1.0, math.inf, math.inf]
            continue
        want = [None] * len(LEVELS) if not len(v) else [float(v[math.floor(p * (len(v) - 1))] + (
            0.0 if (p * (len(v) - 1)).is_integer() else (v[math.ceil(p * (len(v) - 1))] - v[math.floor(p * (len(v) - 1))])
            * (p * (len(v) - 1) - math.floor(p * (len(v) - 1))))) for p in LEVELS]
        assert all(close(a, b) for a, b in zip(r["quantiles"], want)), (g, r["quantiles"], want)
        want = [None] * len(LEVELS) if not len(v) else [float(v[max(1, math.ceil(p * len(v) - 1e-9)) - 1]) for p in LEVELS]
        assert low[g]["quantiles"] == want


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert exact_quantiles(df, "x", [0.5, 0.255]).first()["quantiles"] == [50.0, 25.5]
    none = exact_quantiles(df.limit(0), "x", [0.5]).collect()
    assert [(r["n"], r["quantiles"]) for r in none] == [(0, [None])]
    assert exact_quantiles(df.limit(0).selectExpr("x", "'a' AS g"), "x", [0.5], ["g"]).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(10)], "a double, b int")
    assert {r["column"]: r["quantiles"] for r in column_quantiles(df, ["a", "b"], [0.5, 1.0]).collect()} == {"a": [4.5, 9.0], "b": [0.5, 1.0]}


def test_no_task_holds_a_group(spark):
    """The plan counts parts; no value list or value map of a group is built."""
    from panelkit.operators.quantiles import _narrowed
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "__g0 string, x double")
    state = spark.createDataFrame([("a", 1, 1.0, 2.0, 0)], "__g0 string, rank long, lo double, hi double, below long")
    plan = _narrowed(rows, state, ["__g0"], 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_rows_stay_in_place_for_few_ranks(spark):
    """A group that holds nearly all rows must not be moved to one task."""
    from pyspark.sql import functions as F

    from panelkit.operators import quantiles as Q
    rows = spark.range(4000).select(F.lit("a").alias("__g0"), F.col("id").cast("double").alias("x"))
    state = spark.createDataFrame([("a", 1000, 0.0, 3999.0, 0)], "__g0 string, rank long, lo double, hi double, below long")
    for sent in (True, False):
        d = Q._narrowed(rows, state, ["__g0"], 8, sent)
        assert [tuple(r) for r in d.collect()] == [("a", 1000, 500.0, 999.0, 500)] or d.first()["lo"] <= 999.0 <= d.first()["hi"]
        if sent:
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan
