"""Stored co-moments: merging, adding a year, and the numbers read from them."""
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import comoments as K
from panelkit.operators import stats as S

COLS = ["a", "b", "c"]


def table(spark, shift=0.0):
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(300):
        a, b = rnd.normal(size=2)
        rows.append((2000 + i % 3, float(a) + shift, None if i % 7 == 0 else float(a * 2 + b) + shift, float("nan") if i % 11 == 0 else float(b)))
    return spark.createDataFrame(rows + [(None, 1.0, 2.0, 3.0)], "yr int, a double, b double, c double")


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_merged_state_equals_one_pass(spark, shift):
    """Also where means are large beside the spread, which sums of raw products do not survive."""
    df = table(spark, shift)
    state = K.merged(K.comoments(df, COLS, ["yr"]))
    clean = df.withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    want = {(r["x"], r["y"]): r["r"] for r in S.corr_matrix(clean, COLS).collect()}
    got = {(r["x"], r["y"]): r["r"] for r in K.correlations(state).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    line = {(r["x"], r["y"]): r for r in K.lines(state).collect()}
    ref = S.ols_line(clean, "a", "b").first()
    r = line["a", "b"]
    assert r["n"] == ref["n"] and abs(r["slope"] - ref["slope"]) < 2e-6 and abs(r["r2"] - ref["r2"]) < 2e-6
    assert abs(r["intercept"] - ref["intercept"]) < 2e-6 * max(1.0, shift)
    assert {r["indicator"] for r in K.target_correlations(state, "b").collect()} == {"a", "c"}


def test_adding_a_year_equals_a_full_rebuild_and_leaves_the_others(spark):
    df = table(spark)
    d, full = (tempfile.mkdtemp(prefix="panelkit-state-") for _ in range(2))
    K.write_state(df.where("yr < 2002"), COLS, "yr", d)
    before = {f"{p}/{f}": os.stat(f"{p}/{f}").st_mtime_ns for p, _, fs in os.walk(d) for f in fs if "yr=" in p}
    K.write_state(df.where("yr = 2002 OR yr IS NULL"), COLS, "yr", d)
    assert before and all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    K.write_state(df, COLS, "yr", full)
    a, b = (sorted(map(tuple, K.merged(K.read_state(spark, p)).collect())) for p in (d, full))
    assert len(a) == 6 and all(x[:3] == y[:3] and all(math.isclose(p, q, rel_tol=1e-12, abs_tol=1e-12) for p, q in zip(x[3:], y[3:])) for x, y in zip(a, b))
    K.write_state(df.where("yr = 2000").withColumn("a", F.lit(1.0)), COLS, "yr", d)  # a year written again is replaced
    assert K.read_state(spark, d).where("yr = 2000 AND x = 'a' AND y = 'a'").first()["cxx"] == 0


def test_empty_and_constant(spark):
    df = table(spark).limit(0)
    assert K.comoments(df, COLS).count() == 0 or all(r["n"] == 0 for r in K.comoments(df, COLS).collect())
    one = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in K.correlations(K.merged(K.comoments(one, ["a", "b"]))).collect()}
    assert got["a", "b"] == (1, None)
