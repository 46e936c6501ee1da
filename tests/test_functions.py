"""Goldens for the scalar rules (survey §1.4 D-rules, fixtures A6)."""
import math

from pyspark.sql import functions as F

from panelkit.functions import (canonical_tier, flag, ian_band, leading_int, row_mean_skipna, row_mean_strict,
                                tier_of, to_double, tier_ordinal, attrition_band, lag_band, inde_message)
from panelkit.operators.rules import reasons


def rows(df, col="v"):
    return [r[col] for r in df.collect()]


def test_to_double_bad_tokens_and_nan(spark):
    df = spark.createDataFrame([("7.5",), ("7,5",), ("#NULO!",), ("",), (None,), ("NaN",), (" 3 ",)], "s string")
    assert rows(df.select(to_double("s").alias("v"))) == [7.5, None, None, None, None, None, 3.0]
    assert rows(df.select(to_double("s", decimal_comma=True).alias("v")))[1] == 7.5


def test_mojibake_and_spelling_repair(spark):
    df = spark.createDataFrame([("Ã\x81gata",), ("TopÃ¡zio",), ("Agata",), ("#NULO!",), ("D9891/2A",), ("Quartzo",),
                                (None,)], "s string")
    assert rows(df.select(canonical_tier("s").alias("v"))) == ["Ágata", "Topázio", "Ágata", None, None, "Quartzo", None]
    assert rows(df.select(tier_ordinal(canonical_tier("s")).alias("v"))) == [2, 4, 2, None, None, 1, None]


def test_tier_cut_points_and_missing(spark):
    vals = [5.505, 5.506, 6.867, 6.868, 8.229, 8.230, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert rows(df.select(tier_of("x").alias("v"))) == [
        "Quartzo", "Ágata", "Ágata", "Ametista", "Ametista", "Topázio", "Sem classificação"]


def test_nan_compares_false_after_load(spark):
    # NaN must become NULL at load, then flags treat it as 0
    df = spark.createDataFrame([(float("nan"),), (4.0,), (None,)], "x double")
    out = rows(df.select(flag(to_double("x") < 5).alias("v")))
    assert out == [0, 1, 0]


def test_ian_bands(spark):
    df = spark.createDataFrame([(8.0,), (7.99,), (5.0,), (2.5,), (2.49,), (None,)], "x double")
    assert rows(df.select(ian_band("x").alias("v"))) == [
        "Adequado", "Moderadamente defasado", "Moderadamente defasado", "Severamente defasado",
        "Criticamente defasado", "Sem dados"]


def test_row_means(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, None, None), (3.0, 3.0, 6.0)], "a double, b double, c double")
    skip = rows(df.select(row_mean_skipna(["a", "b", "c"]).alias("v")))
    strict = rows(df.select(row_mean_strict(["a", "b", "c"]).alias("v")))
    assert skip == [1.5, None, 4.0]
    assert strict == [None, None, 4.0]


def test_phase_codes(spark):
    df = spark.createDataFrame([("2H",), ("10A",), ("X",), ("",), (None,)], "s string")
    assert rows(df.select(leading_int("s").alias("v"))) == [2, 10, None, None, None]


def test_reasons_default_and_order(spark):
    df = spark.createDataFrame([(1.0, 9.0), (9.0, 9.0)], "a double, b double")
    r = rows(df.select(reasons([F.col("a") < 5, F.col("b") < 5], ["A", "B"], "none").alias("v")))
    assert r == [["A"], ["none"]]


def test_probability_bands(spark):
    df = spark.createDataFrame([(0.29,), (0.30,), (0.60,), (0.61,), (None,)], "p double")
    assert rows(df.select(attrition_band("p").alias("v"))) == ["Estável", "Acompanhar", "Acompanhar", "Atenção", None]
    df2 = spark.createDataFrame([(0.2,), (0.5,), (0.51,)], "p double")
    assert rows(df2.select(lag_band("p").alias("v"))) == ["Baixo", "Médio", "Alto"]
    df3 = spark.createDataFrame([(4.0,), (None,), (8.5,)], "x double")
    assert rows(df3.select(inde_message("x").alias("v")))[1] == "Em desenvolvimento — acompanhamento necessário"


def test_tenure_reference_year_and_clip(spark):
    from panelkit.functions.core import tenure
    df = spark.createDataFrame([(2018,), (2024,), (None,)], "y int")
    assert rows(df.select(tenure("y", 2022).alias("v"))) == [4, -2, None]
    assert rows(df.select(tenure("y", 2022, clip_at_zero=True).alias("v"))) == [4, 0, None]


def test_append_snapshot_flags_duplicate_year(spark):
    from panelkit.operators.reshape import append_snapshot
    long = spark.createDataFrame([(1, 2022, 6.0), (2, 2021, 5.0)], "e int, yr int, inde double")
    snap = spark.createDataFrame([(1, 7.0), (2, 8.0)], "e int, inde double")
    out = {(r["e"], r["yr"], r["inde"]): r["dup_year"] for r in append_snapshot(long, snap, "e", "yr", 2022).collect()}
    assert out == {(1, 2022, 6.0): 1, (1, 2022, 7.0): 1, (2, 2021, 5.0): 0, (2, 2022, 8.0): 0}
