"""Survey §5 properties: shares sum to 100 within complete groups, leavers +
stayers = present, seeded determinism, probabilities sum to one."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkit.operators import aggregates as A
from panelkit.operators import windows as W
from panelkit.plans import models as M
from tests.conftest import SF_SMALL


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(2000, 2002), st.sampled_from(["a", "b", "c"])), min_size=1, max_size=40))
def test_shares_sum_to_100_without_nulls(spark, rows):
    df = spark.createDataFrame(rows, "yr int, cat string")
    out = A.group_share(df, "yr", "cat").groupBy("yr").agg(F.sum(F.col("n") / F.col("total") * 100).alias("s"))
    assert all(abs(r["s"] - 100.0) < 1e-9 for r in out.collect())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(1995, 2001)), min_size=1, max_size=30))
def test_leavers_plus_stayers_equal_present(spark, keys):
    df = spark.createDataFrame(sorted(keys), "e int, yr int")
    present = df.filter(F.col("yr").between(1995, 2000)).count()
    assert W.leavers(df, "e", "yr", 1995, 2000).count() + W.stayers(df, "e", "yr", 1995, 2000).count() == present
    left = W.transitions(df, "e", "yr", 1995, 2000).agg(F.sum("left")).first()[0] or 0
    assert left == W.leavers(df, "e", "yr", 1995, 2000).count()


def test_seeded_fit_is_deterministic_and_probabilities_sum_to_one(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"),
                                 (F.col("id") % 7).cast("double").alias("z"))
    df = M.class_weights(df.withColumn("label", (F.col("x") + F.col("z") >= 8).cast("int")))
    spec = {"kind": "rf", "numTrees": 8, "maxDepth": 3, "minInstancesPerNode": 2}
    a = M.fit(df, ["x", "z"], spec, seed=7).transform(df)
    b = M.fit(df, ["x", "z"], spec, seed=7).transform(df)
    from pyspark.ml.functions import vector_to_array
    pa = [r[0] for r in a.select(vector_to_array("probability")).orderBy(a["id"]).collect()]
    pb = [r[0] for r in b.select(vector_to_array("probability")).orderBy(b["id"]).collect()]
    assert pa == pb
    assert all(abs(sum(p) - 1.0) < 1e-9 for p in pa)


def test_panel_is_unique_per_entity_year_and_in_range(spark):
    from panelkit.plans.panel import INDICATORS, panel_table
    p = panel_table(spark, SF_SMALL)
    assert p.count() == p.select("entity_id", "yr").distinct().count()
    bad = p.filter(" OR ".join(f"({c} < 0 OR {c} > 10)" for c in INDICATORS)).count()
    assert bad == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 2), min_size=5, max_size=120))
def test_split_quota_is_exact_per_class(spark, labels):
    import math
    from panelkit.operators.sampling import stratified_split
    df = spark.createDataFrame(list(enumerate(labels)), "id int, label int")
    got = {r["label"]: r["n"] for r in stratified_split(df, "label", ["id"], 0.2, buckets=8)
           .filter("is_test = 1").groupBy("label").agg(F.count("*").alias("n")).collect()}
    for c in set(labels):
        assert got.get(c, 0) == math.ceil(labels.count(c) * 0.2)
