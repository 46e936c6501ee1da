"""Smoke tests: one-vs-rest boosting (ML8), snapshot reader (S2), non-null
counts (S7), report builders (R6, R7, R13, R14)."""
import os
import tempfile

from pyspark.sql import functions as F

from panelkit.plans import models as M
from panelkit.plans import reports as R
from panelkit.sources.readers import non_null_counts, read_snapshot
from tests.conftest import SF_SMALL


def test_ovr_gbt_multiclass(spark):
    df = spark.range(240).select(F.col("id"), (F.col("id") % 12).cast("double").alias("x"))
    df = df.withColumn("cls", F.when(F.col("x") < 4, "a").when(F.col("x") < 8, "b").otherwise("c"))
    m = M.fit(df, ["x"], {"kind": "gbt_ovr", "maxIter": 5, "maxDepth": 2}, label="label_idx", string_label="cls",
              weight=None)
    out = M.score_multiclass(m, df)
    acc = out.agg(F.avg((F.col("pred_label") == F.col("cls")).cast("double"))).first()[0]
    assert acc > 0.95 and "probs" not in out.columns  # one-vs-rest has no probability column


def test_snapshot_csv_and_non_null_counts(spark):
    d = tempfile.mkdtemp(prefix="panelkit-snap-")
    with open(os.path.join(d, "s.csv"), "w") as f:
        f.write("RA,INDE,PEDRA_2022\nRA-1,7.1,Ametista\nRA-2,,Quartzo\n")
    df = read_snapshot(spark, d, fmt="csv", schema="RA string, INDE double, PEDRA_2022 string")
    got = {r["column"]: r["non_null"] for r in non_null_counts(df).collect()}
    assert got == {"RA": 2, "INDE": 1, "PEDRA_2022": 2}


def test_report_builders(spark):
    from panelkit.plans.panel import panel_table
    p = panel_table(spark, SF_SMALL)
    a = R.adequacy_evolution(p, scale=4)
    assert a["share"].count() > 0 and a["trend"].count() == p.select("yr").distinct().count()
    pe = R.performance_evolution(p, scale=4)
    assert pe["trend"].first()["verdict"] in ("up", "down", "flat")
    md = R.multidimensional(p, scale=4)
    assert md["matrix"].count() == 64 and md["drivers"].count() == 7
    complete = p.dropna(subset=[*R.MULTI, "inde"])
    r = {(x["x"], x["y"]): x["r"] for x in md["matrix"].collect()}
    assert abs(r["ida", "ipp"] - complete.stat.corr("ida", "ipp")) < 1e-6
    ef = R.effectiveness(p, scale=4)
    assert ef["flag_rate"].count() == p.select("yr").distinct().count()
    assert ef["trajectory"].columns == ["yr", "tier", "mean_inde", "mean_ida", "mean_ieg", "n"]
    assert R.turning_point_drivers(p).count() == 6
