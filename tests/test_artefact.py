"""Artefacts: every fitted step is saved and scores raw rows after loading."""
import tempfile

import pytest
from pyspark.sql import functions as F

from panelkit.plans import artefact as AR
from panelkit.plans import features as FT
from panelkit.plans import models as M
from panelkit.plans.panel import panel_table
from tests.conftest import SF_SMALL

#: scores a saved model on rows written by another application
OTHER = """
import sys
from pyspark.sql import SparkSession
from panelkit.plans.artefact import load_artefact
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
load_artefact(sys.argv[1]).transform(s.read.parquet(sys.argv[2])).select("entity_id", "yr", "score", "pred").write.parquet(sys.argv[3])
"""

SMALL = {"kind": "rf", "numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 2}


def test_codes_medians_and_threshold_survive_saving(spark):
    rows = spark.createDataFrame([("b", 3, 1.0), ("a", 1, None), ("b", 2, 4.0), (None, 0, 2.0)], "institution string, row_id int, x double")
    codes = AR.FirstSeenCodes(outputCol="code_out").fit(rows)
    fill = AR.MedianFill(inputCols=["x"]).fit(rows)
    d = tempfile.mkdtemp(prefix="panelkit-artefact-")
    AR.save_artefact(AR.PipelineModel([codes, fill]), d + "/p")
    new = spark.createDataFrame([("a", None), ("zz", 7.0), (None, 1.0)], "institution string, x double")
    got = AR.load_artefact(d + "/p").transform(new).collect()
    assert sorted((r["code_out"], r["x"]) for r in got) == [(-1.0, 1.0), (-1.0, 7.0), (0.0, 2.0)]
    t = AR.ScoreThreshold(threshold=0.123456789012345, band="lag")
    t.write().overwrite().save(d + "/t")
    back = AR.ScoreThreshold.load(d + "/t")
    assert back.getOrDefault("threshold") == 0.123456789012345 and back.getOrDefault("band") == "lag"


def test_median_of_nothing_is_zero(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert AR.MedianFill(inputCols=["x"]).fit(none).getOrDefault("medians") == [0.0]
    assert AR.MedianFill(inputCols=["x"]).fit(none.limit(0)).getOrDefault("medians") == [0.0]


@pytest.mark.parametrize("model", ["turning_point", "tier", "attrition", "lag_risk"])
def test_loaded_artefact_scores_raw_rows(spark, model):
    """Raw rows without any label column get the scores of the fitted pipeline."""
    p, keys, fitted = panel_table(spark, SF_SMALL), ["entity_id", "yr"], []
    if model == "tier":
        data = FT.tier_features(p, coded=False)
        tr, _ = M.prepare_parts(data, data, codes=True, fitted=fitted)
        m = M.fit(tr, FT.TIER_FEATURES, SMALL, label="label_idx", string_label="tier")
        whole, value = AR.artefact(model, fitted, m), "confidence"
        want = M.score_multiclass(m, tr).select(*keys, F.col("confidence").alias("w"))
    else:
        data, feats, fill = {
            "lag_risk": lambda: (FT.lag_features(p), FT.LAG_FEATURES, []),
            "turning_point": lambda: (FT.turning_point_features(p, fill=False, coded=False), FT.TP_FEATURES, FT.TP_FILL),
            "attrition": lambda: (FT.attrition_features(p, 1992, 1997, fill=False), FT.ATTRITION_FEATURES, FT.ATTRITION_FILL)}[model]()
        tr, _ = M.prepare_parts(data, data, fill, codes=model == "turning_point", fitted=fitted)
        m = M.fit(tr, feats, SMALL)
        whole, value = AR.artefact(model, fitted, m, 0.37, {"lag_risk": "lag", "attrition": "attrition"}.get(model)), "score"
        want = M.score_binary(m, tr, 0.37).select(*keys, F.col("score").alias("w"))
    d = tempfile.mkdtemp(prefix="panelkit-artefact-")
    AR.save_artefact(whole, f"{d}/{model}")
    raw = p.drop("lag", "tier") if model not in ("lag_risk", "tier") else p.drop("lag") if model == "lag_risk" else p.drop("tier")
    got = AR.load_artefact(f"{d}/{model}").transform(raw)
    j = want.join(got.select(*keys, F.col(value).alias("g")), keys, "left")
    assert want.count() > 100 and j.where("g IS NULL OR abs(g - w) > 1e-12").count() == 0
    assert got.count() >= want.count()
    smoke = AR.load_artefact(f"{d}/{model}").transform(AR.smoke_rows(spark)).collect()
    assert smoke and all(0 <= r[value] <= 1 for r in smoke)
    found = {r["model"]: (r["present"], r["scores_raw"]) for r in AR.artefact_files(spark, d, [model, "none"]).collect()}
    assert found == {model: (True, True), "none": (False, False)}


def test_another_application_scores_the_same(spark):
    """Saved here, loaded and applied by a process of its own."""
    import os
    import subprocess
    import sys
    p, fitted = panel_table(spark, SF_SMALL), []
    data = FT.turning_point_features(p, fill=False, coded=False)
    tr, _ = M.prepare_parts(data, data, FT.TP_FILL, codes=True, fitted=fitted)
    m = M.fit(tr, FT.TP_FEATURES, SMALL)
    d = tempfile.mkdtemp(prefix="panelkit-artefact-")
    AR.save_artefact(AR.artefact("turning_point", fitted, m, 0.5), d + "/model")
    p.drop("lag", "tier").write.parquet(d + "/raw")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYTHONPATH": root + ":" + os.environ.get("PYTHONPATH", "")}
    subprocess.run([sys.executable, "-c", OTHER, d + "/model", d + "/raw", d + "/out"], check=True, env=env, timeout=300, capture_output=True)
    other = spark.read.parquet(d + "/out")
    here = M.score_binary(m, tr, 0.5).select("entity_id", "yr", F.col("score").alias("w"), F.col("pred").alias("wp"))
    j = here.join(other, ["entity_id", "yr"], "left")
    assert other.count() == here.count() and j.where("NOT (pred <=> wp) OR NOT (score <=> w)").count() == 0
