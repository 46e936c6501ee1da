"""MLlib pipelines: class weights, forests and boosting, cross-validation,
threshold calibration, evaluation, persistence and batch scoring
(ML5–ML16, S4–S6, E7–E9).

Procedure (per model): seeded stratified 80/20 split (W7) → stratified folds
on the training part (W8) → out-of-fold scores from k fits, reused both for
the CV metric (ML9) and the F1 threshold calibration (ML11) → one fit on the
whole training part → train/test metrics with the SQL-checked evaluation
operators (E1, E4, E7) → metric row (E8) → model + metrics saved (S4, S5).

Inputs are checkpointed into the shared checkpoint folder before the
iterative fits so that a lost executor never replays the feature lineage.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit import config as C
from panelkit.functions.bands import attrition_band, lag_band
from panelkit.operators.evaluation import (auc, best_threshold, binary_metrics, one_row, threshold_f1,
                                           threshold_grid)
from panelkit.operators.sampling import stratified_folds, stratified_split
from panelkit.session import cut_lineage, drop_stores, recorded_stores, store

__all__ = ["run_concurrently", "spread", "prepare_split", "fit_folds_and_final", "class_weights", "build_pipeline", "fit", "score_binary", "score_multiclass", "feature_importance",
           "cv_metric", "train_binary", "train_multiclass", "save_model", "load_model",
           "write_metric_rows", "artefact_check", "smoke_inference", "MODEL_SPECS"]

# fixed values: model settings of the four models; only the weighted ones balance the classes
MODEL_SPECS = {
    "lag_risk": {"kind": "hist_rf", "numTrees": 300, "maxDepth": 4, "minInstancesPerNode": 5, "min_thresh": 0.45, "weighted": True},
    "tier": {"kind": "hist_rf", "numTrees": 300, "maxDepth": 6, "minInstancesPerNode": 3},
    "tier_gbt": {"kind": "hist_gb", "maxIter": 300, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8},
    "turning_point": {"kind": "hist_gb", "maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8,
                      "threshold": 0.5},
    "turning_point_rf": {"kind": "hist_rf", "numTrees": 300, "maxDepth": 5, "minInstancesPerNode": 4, "threshold": 0.5,
                         "weighted": True},
    "attrition": {"kind": "hist_rf", "numTrees": 300, "maxDepth": 5, "minInstancesPerNode": 4, "threshold": 0.5, "weighted": True},
}

#: partitions of a model's input. Tree learners draw their samples per partition,
#: so this number is part of the model: it is the same for every data size and
#: cluster. Raise it for a deployment whose training rows need more tasks.
MODEL_PARTITIONS = 8


def spread(df: DataFrame, keys: Sequence[str], partitions: int = MODEL_PARTITIONS) -> DataFrame:
    """Model input in a layout that depends on the rows alone: hash-partitioned
    on the keys and sorted inside, whatever the input's partitions, the row
    count or the task slots."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


#: boosting iterations between two reliable checkpoints
CHECKPOINT_INTERVAL = 10


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """ML5: balanced weights n / (k · n_c). Class counts form a table with
    one row per class (bounded by the number of classes), so it is
    broadcast to the rows."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    w = Window.partitionBy()
    cnt = cnt.select(label, (F.sum("__nc").over(w).cast("double") / (F.count(F.lit(1)).over(w) * F.col("__nc")))
                     .alias(out))
    return df.join(F.broadcast(cnt), label)


def _classifier(spec: dict, label: str, weight: str | None, seed: int):
    kind = spec["kind"]
    weight = weight_column(spec, weight)
    if kind == "rf":
        clf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=spec["numTrees"],
                                     maxDepth=spec["maxDepth"], minInstancesPerNode=spec["minInstancesPerNode"],
                                     featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024)
        return clf.setWeightCol(weight) if weight else clf
    if kind == "gbt":
        clf = GBTClassifier(labelCol=label, featuresCol="features", maxIter=spec["maxIter"],
                            maxDepth=spec["maxDepth"], stepSize=spec["stepSize"],
                            subsamplingRate=spec["subsamplingRate"], seed=seed,
                            maxMemoryInMB=1024, checkpointInterval=CHECKPOINT_INTERVAL)
        return clf.setWeightCol(weight) if weight else clf
    if kind == "gbt_ovr":  # ML8: multiclass boosting as one-vs-rest
        return OneVsRest(classifier=GBTClassifier(maxIter=spec["maxIter"], maxDepth=spec["maxDepth"],
                                                  stepSize=spec.get("stepSize", 0.1),
                                                  subsamplingRate=spec.get("subsamplingRate", 1.0), seed=seed,
                                                  maxMemoryInMB=1024, checkpointInterval=CHECKPOINT_INTERVAL),
                         labelCol=label, featuresCol="features", rawPredictionCol="rawPrediction", parallelism=4)
    raise ValueError(kind)


def build_pipeline(features: Sequence[str], spec: dict, label: str = "label", weight: str | None = "weight",
                   seed: int = C.SEED, string_label: str | None = None, scale: bool = False) -> Pipeline:
    """Assembler (+ optional scaler, ML15) (+ label indexer) + classifier."""
    stages = []
    lab = label
    if string_label:
        stages.append(StringIndexer(inputCol=string_label, outputCol="label_idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        lab = "label_idx"
    stages.append(VectorAssembler(inputCols=list(features), outputCol="raw_features" if scale else "features",
                                  handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    stages.append(_classifier(spec, lab, weight, seed))
    return Pipeline(stages=stages)


def fit(train: DataFrame, features, spec, **kw) -> PipelineModel:
    if spec["kind"].startswith("hist"):
        return fit_histogram(train, features, spec, [None], **kw)[0]
    return build_pipeline(features, spec, **kw).fit(train)


def weight_column(spec: dict, weight: str | None) -> str | None:
    """Only the models with balanced classes are fitted with weights."""
    return weight if spec.get("weighted") else None


def fit_histogram(train: DataFrame, features: Sequence[str], spec: dict, fits: Sequence[int | None], label: str = "label",
                  weight: str | None = "weight", seed: int = C.SEED, string_label: str | None = None, fold: str | None = None,
                  keys: Sequence[str] | None = None) -> list[PipelineModel]:
    """Forests (``hist_rf``) and multinomial boosting (``hist_gb``) whose trees depend
    on the rows alone. All ``fits`` (None: every row, k: without fold k) grow together."""
    from panelkit.plans.histtrees import fit_boosting, fit_forest
    keys = list(keys or [k for k in ("entity_id", "yr") if k in train.columns] or features)
    stages, classes = [], 2
    if string_label:
        stages.append(StringIndexer(inputCol=string_label, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train))
        train, label, classes = stages[0].transform(train), "label_idx", len(stages[0].labels)
    weight = weight_column(spec, weight)
    common = {"key": keys, "seed": seed, "fold": fold, "fits": fits}
    if spec["kind"] == "hist_rf":
        models = fit_forest(train, features, label, classes, trees=spec["numTrees"], depth=spec["maxDepth"], min_leaf=spec["minInstancesPerNode"],
                            weight=weight if weight in train.columns else None, **common)
    else:
        models = fit_boosting(train, features, label, classes, rounds=spec["maxIter"], depth=spec["maxDepth"], rate=spec["stepSize"],
                              subsample=spec["subsamplingRate"], **common)
    return [PipelineModel([*stages, VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), m]) for m in models]


def _fit_all(train: DataFrame, features, specs: dict, k: int, fold: str, **kw) -> dict:
    """Tasks for :func:`run_concurrently`: a candidate's final fit and its fold fits;
    histogram learners grow all of them in the same jobs."""
    tasks = {}
    for c, spec in specs.items():
        if spec["kind"].startswith("hist"):
            tasks[c] = (lambda spec=spec: fit_histogram(train, features, spec, [None, *range(k)], fold=fold, **kw))
            continue
        tasks[(c, "final")] = (lambda spec=spec: fit(train, features, spec, **kw))
        for i in range(k):
            tasks[(c, i)] = (lambda spec=spec, i=i: fit(train.filter(F.col(fold) != i), features, spec, **kw))
    return tasks


def _by_fold(res: dict, k: int) -> dict:
    """{(candidate, "final" or fold): model}."""
    out = {}
    for key, v in res.items():
        out |= {key: v} if isinstance(key, tuple) else {(key, i): m for i, m in zip(["final", *range(k)], v)}
    return out


def score_binary(model: PipelineModel, df: DataFrame, threshold: float, band: str | None = None) -> DataFrame:
    """ML12/ML14: probability of class 1, flag at the threshold, band text."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    out = out.withColumn("pred", (F.col("score") >= F.lit(threshold)).cast("int"))
    if band == "attrition":
        out = out.withColumn("band", attrition_band("score"))
    elif band == "lag":
        out = out.withColumn("band", lag_band("score"))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def score_multiclass(model: PipelineModel, df: DataFrame) -> DataFrame:
    """ML13: predicted label text, per-class probability map, confidence."""
    idx = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"][0]
    labels = list(idx.labels)
    out = model.transform(df)
    out = IndexToString(inputCol="prediction", outputCol="pred_label", labels=labels).transform(out)
    names = F.array(*[F.lit(x) for x in labels])
    if "probability" in out.columns:
        arr = F.slice(vector_to_array("probability"), 1, len(labels))  # the indexer keeps a place for unseen labels
        out = out.withColumn("probs", F.map_from_arrays(names, arr)).withColumn("confidence", F.array_max(arr))
    elif "rawPrediction" in out.columns:  # one-vs-rest boosting: margins, whose order is all that an AUC needs
        out = out.withColumn("margins", F.map_from_arrays(names, F.slice(vector_to_array("rawPrediction"), 1, len(labels))))
    return out.drop("features", "rawPrediction", "probability")


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """ML16: (feature, importance) sorted desc. The vector has one entry per
    feature (model metadata, not data)."""
    clf = model.stages[-1]
    imp = clf.featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def run_concurrently(tasks: dict, parallelism: int = 4) -> dict:
    """Run independent Spark actions from driver threads so that their jobs
    share the executors (what ``CrossValidator(parallelism=...)`` does):
    small per-iteration jobs of tree learners leave most task slots idle
    when run one model at a time. Returns {name: result}."""
    from concurrent.futures import ThreadPoolExecutor
    if parallelism <= 1 or len(tasks) <= 1:
        return {k: f() for k, f in tasks.items()}
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as ex:
        futs = {k: ex.submit(f) for k, f in tasks.items()}
        return {k: fu.result() for k, fu in futs.items()}


def fit_folds_and_final(train: DataFrame, features, specs: dict, k: int = C.N_FOLDS, label: str = "label",
                        fold: str = "fold", parallelism: int = 8, **kw) -> dict:
    """All fits of a model selection at once: for every candidate spec, the
    k fold models and the final model on the whole training part. None of
    them depends on another's result, so they are submitted together and
    share the executors. Returns {candidate: {"final": model, "oof": scores}}
    with the out-of-fold scores checkpointed."""
    res = _by_fold(run_concurrently(_fit_all(train, features, specs, k, fold, label=label, **kw), parallelism), k)
    out = {}
    for c in specs:
        parts = [res[(c, i)].transform(train.filter(F.col(fold) == i)).select(
            fold, label, vector_to_array("probability")[1].alias("score")) for i in range(k)]
        out[c] = {"final": res[(c, "final")], "oof": store(reduce(DataFrame.unionByName, parts))}
    return out


def cv_metric(oof: DataFrame, metric: str = "auc", threshold: float = 0.5, label: str = "label") -> DataFrame:
    """ML9: per-fold metric → mean ± sample std (one row)."""
    if metric == "auc":
        per = auc(oof, label, "score", keys=["fold"])
    else:
        per = binary_metrics(oof.withColumn("pred", (F.col("score") >= threshold).cast("int")), label, "pred",
                             keys=["fold"]).select("fold", F.col(metric).alias(metric))
    return per.agg(F.avg(metric).alias(f"cv_{metric}_mean"), F.stddev_samp(metric).alias(f"cv_{metric}_std"))


def prepare_split(data: DataFrame, keys: Sequence[str], seed: int = C.SEED, label: str = "label",
                  fill_cols: Sequence[str] = (), codes: bool = False, fitted: list | None = None):
    """Stratified 80/20 split first; then, fitted on the training part only
    (D23) and applied to both parts: institution codes (``codes``), medians of
    ``fill_cols`` and class weights; stratified folds on the training part.
    Each step is stored: returns (train with ``fold`` and ``weight``, test);
    the fitted steps are added to ``fitted``."""
    with recorded_stores() as steps:
        split = store(stratified_split(data, label, keys, C.TEST_FRACTION, seed))
        tr, te = prepare_parts(split.filter("is_test = 0"), split.filter("is_test = 1"), fill_cols, codes, fitted)
        train = class_weights(store(tr), label)
    train = store(spread(stratified_folds(train, label, keys, C.N_FOLDS, seed), keys))
    test = store(te)
    drop_stores(data.sparkSession, steps)
    return train, test


def prepare_parts(tr: DataFrame, te: DataFrame, fill_cols: Sequence[str] = (), codes: bool = False, fitted: list | None = None):
    """Codes and medians of the training part, applied to both; the fitted steps
    are added to ``fitted``, to be saved with the model."""
    from panelkit.plans.artefact import FirstSeenCodes, MedianFill
    from panelkit.plans.features import with_row_id
    fitted = fitted if fitted is not None else []
    if codes:
        fitted.append(FirstSeenCodes().fit(with_row_id(tr)))
        tr, te = fitted[-1].transform(tr), fitted[-1].transform(te)
    if fill_cols:
        fitted.append(MedianFill(inputCols=list(fill_cols)).fit(tr))
        tr, te = fitted[-1].transform(tr), fitted[-1].transform(te)
    return tr, te


def train_binary(data: DataFrame, features: Sequence[str], spec: dict, keys: Sequence[str],
                 cv_metric_name: str = "f1", calibrate: bool = True, seed: int = C.SEED,
                 prepared=None, oof: DataFrame | None = None, model: PipelineModel | None = None) -> dict:
    """Full binary procedure; returns model, threshold, scored test rows and a
    one-row metrics frame. ``prepared`` (train, test), ``oof`` and ``model``
    let a caller reuse a split, out-of-fold scores and a final fit it
    already has; otherwise fold fits and the final fit run together."""
    train, test = prepared if prepared is not None else prepare_split(data, keys, seed)
    if oof is None or model is None:
        r = fit_folds_and_final(train, features, {"m": spec}, seed=seed)["m"]
        oof, model = (oof if oof is not None else r["oof"]), (model if model is not None else r["final"])
    if calibrate and "threshold" not in spec:
        grid = threshold_grid(spec.get("min_thresh", 0.20), 0.80)
        thr = best_threshold(threshold_f1(oof, grid)).first()["threshold"]  # one scalar
    else:
        thr = float(spec.get("threshold", 0.5))
    s_tr = score_binary(model, train, thr)
    s_te = score_binary(model, test, thr)
    m_tr = binary_metrics(s_tr)
    m_te = binary_metrics(s_te)
    cvm = cv_metric(oof, cv_metric_name, thr)
    row = (one_row([m_te.select(F.col("accuracy").alias("accuracy_test"), F.col("f1").alias("f1_test"),
                                F.col("recall").alias("recall_test"), F.col("precision").alias("precision_test")),
                    auc(s_te).select(F.col("auc").alias("auc_test")),
                    m_tr.select(F.col("accuracy").alias("accuracy_train")), cvm])
           .withColumn("threshold", F.lit(float(thr)))
           .withColumn("gap_accuracy", F.col("accuracy_train") - F.col("accuracy_test")))
    return {"model": model, "threshold": thr, "test_scores": s_te, "metrics": row, "oof": oof}


def train_multiclass(data: DataFrame, features: Sequence[str], specs: dict, keys: Sequence[str],
                     label_text: str = "tier", seed: int = C.SEED, codes: bool = True, parallelism: int = 12) -> dict:
    """Multiclass procedure (tier): split stratified on the label text, every
    candidate in ``specs`` cross-validated on the training part, the one with
    the best mean accuracy evaluated on the test part (accuracy, weighted F1,
    weighted one-vs-rest AUC)."""
    from panelkit.operators.evaluation import auc_ovr_weighted, weighted_f1
    split = cut_lineage(stratified_split(data, label_text, keys, C.TEST_FRACTION, seed))
    fitted: list = []
    tr, te = prepare_parts(split.filter("is_test = 0"), split.filter("is_test = 1"), codes=codes, fitted=fitted)
    train = cut_lineage(spread(stratified_folds(cut_lineage(tr), label_text, keys, C.N_FOLDS, seed), keys))
    test = cut_lineage(te)
    kw = {"label": "label_idx", "string_label": label_text, "seed": seed}
    models = _by_fold(run_concurrently(_fit_all(train, features, specs, C.N_FOLDS, "fold", **kw), parallelism), C.N_FOLDS)

    def acc(s, *by):
        return s.groupBy(*by).agg(F.avg((F.col("pred_label") == F.col(label_text)).cast("double")).alias("acc"))
    rows = []
    for c in specs:
        oof = reduce(DataFrame.unionByName, [
            score_multiclass(models[(c, i)], train.filter(F.col("fold") == i)).select("fold", label_text, "pred_label")
            for i in range(C.N_FOLDS)])
        rows.append(acc(oof, "fold").agg(F.avg("acc").alias("cv_accuracy"), F.stddev_samp("acc").alias("cv_accuracy_std"))
                    .withColumn("candidate", F.lit(c)))
    cv = cut_lineage(reduce(DataFrame.unionByName, rows))
    best = cv.agg(F.max_by("candidate", "cv_accuracy")).first()[0]  # one name
    model = models[(best, "final")]
    s_te, s_tr = cut_lineage(score_multiclass(model, test)), score_multiclass(model, train)
    wf1 = weighted_f1(s_te.select(F.col(label_text).alias("label"), F.col("pred_label").alias("pred")))
    labels = list([s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"][0].labels)
    scores = "probs" if "probs" in s_te.columns else "margins"
    probs = s_te.select(label_text, *[F.col(scores).getItem(x).alias(f"p{i}") for i, x in enumerate(labels)])
    row = one_row([acc(s_te).select(F.col("acc").alias("accuracy_test")),
                   acc(s_tr).select(F.col("acc").alias("accuracy_train")), wf1.select("weighted_f1"),
                   auc_ovr_weighted(probs, label_text, {x: f"p{i}" for i, x in enumerate(labels)})
                   .select(F.col("auc_ovr_weighted").alias("auc_ovr")),
                   cv.filter(F.col("candidate") == best).select("cv_accuracy", "cv_accuracy_std")])
    return {"model": model, "test_scores": s_te, "metrics": row.withColumn("candidate", F.lit(best)), "candidates": cv,
            "fitted": fitted}


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the whole fitted pipeline (assembler, indexer, model)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_metric_rows(rows: dict[str, DataFrame], path: str) -> DataFrame:
    """Tag each one-row metric frame with its model name, union,
    write as JSON; returns the union."""
    from panelkit.operators.evaluation import metric_rows
    from panelkit.sources.readers import write_metrics
    df = metric_rows(rows)
    write_metrics(df, path)
    return df


def artefact_check(spark, expected: Sequence[str], metrics: DataFrame) -> DataFrame:
    """Expected model names left-joined to the metric rows; ``present``
    is false for a model whose metrics are missing."""
    exp = spark.createDataFrame([(m,) for m in expected], "model string")
    have = metrics.select("model").distinct().withColumn("present", F.lit(True))
    return exp.join(have, "model", "left").fillna(False, ["present"])


def smoke_inference(model: PipelineModel, spark, features: Sequence[str], value: float = 5.0) -> DataFrame:
    """Score one synthetic all-``value`` row; probabilities must lie in [0, 1]."""
    row = spark.createDataFrame([tuple(float(value) for _ in features)], ", ".join(f"{f} double" for f in features))
    out = model.transform(row).withColumn("p", vector_to_array("probability"))
    return out.select(F.forall("p", lambda x: (x >= 0) & (x <= 1)).alias("valid"), "p")
