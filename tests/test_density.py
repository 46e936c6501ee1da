"""Binned densities stay within their stated bound of the exact ones."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import stats as S


@pytest.mark.parametrize("bins", [50, 2000])
def test_within_the_bound_of_the_exact_form(spark, bins):
    rnd = np.random.default_rng(3)
    data = [("a", float(v)) for v in rnd.normal(size=2000)] + [("b", float(v)) for v in rnd.exponential(size=500) * 100]
    data += [("flat", 1.0)] * 5 + [("one", 2.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    exact = {(r["g"], r["i"]): r for r in S.density_grid(df, "v", "g").collect()}
    got = {(r["g"], r["i"]): r for r in S.density_binned(df, "v", "g", bins=bins).collect()}
    assert got.keys() == exact.keys() and {g for g, _ in got} == {"a", "b"}
    for k, r in got.items():
        assert r["x"] == pytest.approx(exact[k]["x"], abs=1e-6)
        assert abs(r["density"] - exact[k]["density"]) <= r["bound"] + 2e-9
    if bins == 2000:
        assert max(r["bound"] for k, r in got.items() if k[0] == "a") < 1e-4


def test_mass_is_kept_and_nan_left_out(spark):
    df = spark.createDataFrame([("a", float(i % 97)) for i in range(1000)] + [("a", float("nan"))], "g string, v double")
    r = S.density_binned(df, "v", "g", points=100).orderBy("i").collect()
    exact = S.density_grid(df.where(~F.isnan("v")), "v", "g").orderBy("i").collect()
    assert len(r) == 100 and all(abs(a["density"] - b["density"]) <= a["bound"] + 2e-9 for a, b in zip(r, exact))
    assert S.density_binned(df.limit(0), "v", "g").count() == 0
