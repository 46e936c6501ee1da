"""End-to-end training run for the four models (the Spark form of a
training script): features → split/folds → cross-validated scores →
threshold calibration / candidate comparison → final fit → metrics,
feature importances, saved pipelines and metric JSON → artefact check.

The four models are independent and are trained concurrently.

usage: python -m panelkit.plans.training SF_DIR OUT_DIR
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.plans import artefact as AR
from panelkit.plans import features as FT
from panelkit.plans import models as M
from panelkit import config as C
from panelkit.plans.panel import panel_table, year_bounds

__all__ = ["train_all"]

KEYS = ["entity_id", "yr"]
#: risk bands of the binary models
BANDS = {"lag_risk": "lag", "attrition": "attrition"}


def _binary(p: DataFrame, name: str, specs: dict, parallelism: int) -> dict:
    # medians and institution codes are fitted on the training part inside prepare_split
    codes = False
    if name == "lag_risk":
        data, feats, metric, fill = FT.lag_features(p), FT.LAG_FEATURES, "f1", []
    elif name == "attrition":
        first, last = year_bounds(p)
        data, feats, metric, fill = (FT.attrition_features(p, first, last - 1, fill=False), FT.ATTRITION_FEATURES, "auc",
                                     FT.ATTRITION_FILL)
        positives = data.agg(F.count_if(F.col("label") == 1)).first()[0]  # one number
        if positives < C.MIN_POSITIVES:
            raise ValueError(f"only {positives} entities left: at least {C.MIN_POSITIVES} are needed for an attrition model")
    else:
        data, feats, metric, fill = (FT.turning_point_features(p, fill=False, coded=False), FT.TP_FEATURES, "auc", FT.TP_FILL)
        codes = True
    fitted: list = []
    prepared = M.prepare_split(data, KEYS, fill_cols=fill, codes=codes, fitted=fitted)
    cands = {name: specs[name]}
    if name == "turning_point":
        cands["turning_point_rf"] = specs["turning_point_rf"]
    fits = M.fit_folds_and_final(prepared[0], feats, cands, parallelism=6 * len(cands))
    best = name
    if len(cands) > 1:
        # ML10: boosting vs forest candidate, chosen by cross-validated AUC on
        # the training part (never on the test part)
        from functools import reduce
        rows = [M.cv_metric(f["oof"], "auc").withColumn("candidate", F.lit(c)) for c, f in fits.items()]
        best = reduce(DataFrame.unionByName, rows).agg(
            F.max_by("candidate", "cv_auc_mean")).first()[0]  # one name
    r = M.train_binary(data, feats, specs[best], KEYS, cv_metric_name=metric, calibrate=(name == "lag_risk"),
                       prepared=prepared, oof=fits[best]["oof"], model=fits[best]["final"])
    r["candidate"] = best
    r["features"] = feats
    r["fitted"] = fitted
    return r


def train_all(spark: SparkSession, sf_dir: str, out_dir: str, specs: dict | None = None,
              parallelism: int = 4) -> DataFrame:
    """Train, evaluate and persist the four models; returns the metric rows."""
    specs = specs or M.MODEL_SPECS
    p = panel_table(spark, sf_dir)
    tasks = {n: (lambda n=n: _binary(p, n, specs, parallelism)) for n in ["lag_risk", "turning_point", "attrition"]}
    tiers = {c: specs[c] for c in ("tier", "tier_gbt") if c in specs}
    tasks["tier"] = lambda: dict(M.train_multiclass(FT.tier_features(p, coded=False), FT.TIER_FEATURES, tiers, KEYS),
                                 features=FT.TIER_FEATURES)
    results = M.run_concurrently(tasks, parallelism)
    rows = {}
    for name, r in results.items():
        # the saved pipeline scores raw panel rows: features, codes, medians, learner, threshold, band
        AR.save_artefact(AR.artefact(name, r["fitted"], r["model"], r.get("threshold"), BANDS.get(name)), f"{out_dir}/models/{name}")
        if hasattr(r["model"].stages[-1], "featureImportances"):
            M.feature_importance(r["model"], r["features"]).coalesce(1).write.mode("overwrite").json(
                f"{out_dir}/importance/{name}")
        rows[name] = r["metrics"]
    metrics = M.write_metric_rows(rows, f"{out_dir}/metrics")
    files = AR.artefact_files(spark, f"{out_dir}/models", list(tasks))
    M.artefact_check(spark, list(tasks), metrics).join(files.withColumnRenamed("present", "saved"), "model").coalesce(1).write.mode("overwrite").json(f"{out_dir}/artefacts")
    return metrics


if __name__ == "__main__":
    from panelkit.session import get_session
    s = get_session("local[*]")
    out = train_all(s, sys.argv[1], sys.argv[2])
    out.show(truncate=False)
