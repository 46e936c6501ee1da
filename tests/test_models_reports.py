"""Model persistence, artefact check, candidate comparison, OvR AUC and the
overview report builder."""
import tempfile

from pyspark.sql import functions as F

from panelkit.operators.evaluation import auc, auc_ovr_weighted
from panelkit.plans import models as M
from panelkit.plans.reports import overview
from tests.conftest import SF_SMALL


def _data(spark, n=300):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"),
                               (F.col("id") % 7).cast("double").alias("z"))
    return df.withColumn("label", (F.col("x") >= 5).cast("int"))


def test_save_load_and_artefacts(spark):
    df = M.class_weights(_data(spark))
    m = M.fit(df, ["x", "z"], {"kind": "rf", "numTrees": 5, "maxDepth": 2, "minInstancesPerNode": 1})
    d = tempfile.mkdtemp(prefix="panelkit-model-")
    M.save_model(m, d + "/rf")
    m2 = M.load_model(d + "/rf")
    a = M.score_binary(m, df, 0.5).select("id", "score").orderBy("id").collect()
    b = M.score_binary(m2, df, 0.5).select("id", "score").orderBy("id").collect()
    assert a == b
    metrics = M.write_metric_rows({"rf": M.score_binary(m, df, 0.5).agg(F.avg("pred").alias("rate"))}, d + "/metrics")
    chk = {r["model"]: r["present"] for r in M.artefact_check(spark, ["rf", "gbt"], metrics).collect()}
    assert chk == {"rf": True, "gbt": False}


def test_weights_follow_the_spec(spark):
    """Only lag risk, the turning-point forest and attrition balance their classes."""
    assert {n for n, s in M.MODEL_SPECS.items() if s.get("weighted")} == {"lag_risk", "turning_point_rf", "attrition"}
    for name, spec in M.MODEL_SPECS.items():
        assert (M.weight_column(spec, "weight") == "weight") == bool(spec.get("weighted")), name
        if spec["kind"] in ("rf", "gbt"):
            clf = M.build_pipeline(["x"], spec).getStages()[-1]
            assert (clf.isSet("weightCol") and clf.getWeightCol() == "weight") == bool(spec.get("weighted")), name


def test_scores_do_not_depend_on_partitions(spark):
    """The same rows in 1, 3 or 7 partitions give the same forest and the same boosting."""
    df = _data(spark, 400).withColumn("w", F.rand(3))
    for spec in ({"kind": "rf", "numTrees": 6, "maxDepth": 3, "minInstancesPerNode": 1},
                 {"kind": "gbt", "maxIter": 3, "maxDepth": 2, "stepSize": 0.1, "subsamplingRate": 0.5}):
        got = []
        for n in (1, 3, 7):
            train = M.spread(df.repartition(n, "w"), ["id"])
            m = M.fit(train, ["x", "z"], spec)
            got.append([r["score"] for r in M.score_binary(m, df, 0.5).orderBy("id").collect()])
        assert got[0] == got[1] == got[2]


def test_no_feature_is_made_from_an_excluded_column():
    from panelkit.plans.features import excluded_inputs
    assert excluded_inputs() == []


def test_turning_point_mean_does_not_hold_the_label(spark):
    """The mean is over four indicators: five times it minus these says nothing about IPV."""
    from panelkit.plans.features import turning_point_features
    from panelkit.plans.panel import panel_table
    p = panel_table(spark, SF_SMALL)
    f = turning_point_features(p).join(p.select("entity_id", "yr", "ipv"), ["entity_id", "yr"])
    r = f.agg(F.max(F.abs(4 * F.col("MEDIA_INDICADORES") - (F.col("IAA") + F.col("IEG") + F.col("IPS") + F.col("IDA")))),
              F.count_if(F.abs(5 * F.col("MEDIA_INDICADORES") - (F.col("IAA") + F.col("IEG") + F.col("IPS") + F.col("IDA"))
                               - F.col("ipv")) < 1e-9), F.count("*")).first()
    assert r[0] < 1e-9 and r[1] < 0.05 * r[2]


def test_missing_labels_are_a_stratum(spark):
    from panelkit.operators.sampling import stratified_folds, stratified_split
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id int, label int")
    assert stratified_split(df, "label", ["id"], 0.2).count() == 50
    f = {r["fold"]: r["n"] for r in stratified_folds(df, "label", ["id"], 5).filter("label IS NULL")
         .groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert f == {i: 2 for i in range(5)}


def test_recommendations_read_missing_as_zero(spark):
    from panelkit.operators.rules import recommendations
    df = spark.createDataFrame([(None, None, None, None)], "ieg double, ips double, ida double, iaa double")
    assert len(df.select(recommendations()).first()[0]) == 3
    assert df.select(recommendations(missing_as="no_signal")).first()[0] == ["Indicadores adequados. Manter acompanhamento regular."]


def test_auc_ovr_weighted_perfect(spark):
    df = spark.createDataFrame([(c, 1.0 if c == 0 else 0.0, 1.0 if c == 1 else 0.0, 1.0 if c == 2 else 0.0)
                                for c in [0, 1, 2, 0, 1, 2, 2]], "y int, p0 double, p1 double, p2 double")
    assert auc_ovr_weighted(df, "y", {0: "p0", 1: "p1", 2: "p2"}).first()[0] == 1.0


def test_overview_report(spark):
    from panelkit.plans.panel import panel_table
    p = panel_table(spark, SF_SMALL)
    out = overview(p, ["ieg", "ida", "ips"], scale=4)
    assert out["tier_mix"].count() > 0 and out["radar"].count() > 0
    assert out["best_worst"].first()["best"] in ("ieg", "ida", "ips")


def test_train_all_small(spark):
    """Full training run on sf0.001 with small forests (speed only; the
    procedure is the same as with the reference settings)."""
    from panelkit.plans.training import train_all
    small = {"lag_risk": {"kind": "hist_rf", "numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 5, "min_thresh": 0.45},
             "tier": {"kind": "rf", "numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 3},
             "tier_gbt": {"kind": "hist_gb", "maxIter": 2, "maxDepth": 2, "stepSize": 0.05, "subsamplingRate": 0.8},
             "turning_point": {"kind": "gbt", "maxIter": 3, "maxDepth": 2, "stepSize": 0.1, "subsamplingRate": 0.8,
                               "threshold": 0.5},
             "turning_point_rf": {"kind": "rf", "numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 4},
             "attrition": {"kind": "rf", "numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 4, "threshold": 0.5}}
    out = tempfile.mkdtemp(prefix="panelkit-train-")
    m = train_all(spark, SF_SMALL, out, specs=small)
    rows = {r["model"]: r for r in m.collect()}
    assert set(rows) == {"lag_risk", "tier", "turning_point", "attrition"}
    assert 0.0 <= rows["attrition"]["auc_test"] <= 1.0
    assert 0.0 <= rows["tier"]["auc_ovr"] <= 1.0 and 0.0 <= rows["tier"]["cv_accuracy"] <= 1.0
    assert rows["tier"]["candidate"] in ("tier", "tier_gbt")
    art = spark.read.json(out + "/artefacts").collect()
    assert all(r["present"] for r in art)
    assert all(r["saved"] and r["scores_raw"] for r in art)
    from panelkit.plans.artefact import load_artefact, smoke_rows
    for name in rows:
        p = load_artefact(f"{out}/models/{name}").transform(smoke_rows(spark)).collect()
        assert p and all(0 <= r["confidence" if name == "tier" else "score"] <= 1 for r in p)


def test_one_vs_rest_boosting_stays_available(spark):
    df = _data(spark, 200).withColumn("name", F.when(F.col("x") < 3, "a").when(F.col("x") < 6, "b").otherwise("c"))
    m = M.fit(df, ["x", "z"], {"kind": "gbt_ovr", "maxIter": 2, "maxDepth": 2, "stepSize": 0.1}, string_label="name")
    assert M.score_multiclass(m, df).where("pred_label = name").count() > 150
