"""Evaluation operators over any scored table (E1–E8, W9, W10, J7, ML11).

They are plain aggregations, so model quality is measured with the same
SQL-checkable machinery as every other report. The ranking metrics (ROC,
AUC) need global prefix sums over scores; :func:`ordered_prefix_sums`
computes them without an unpartitioned window: scores are pre-aggregated to
distinct values, cut into ~``buckets`` ranges at approximate quantiles (a
scalar subquery), prefix sums run per range in parallel, and the range
offsets come from a table with one row per range.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

__all__ = ["one_row", "binary_metrics", "confusion", "class_report", "weighted_f1", "ordered_prefix_sums",
           "score_groups", "roc_points", "auc", "auc_ovr_weighted", "threshold_grid", "threshold_f1",
           "best_threshold", "train_test_gap", "metric_rows"]


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy / precision / recall / F1 (zero_division = 0)."""
    y, p = F.col(label), F.col(pred)
    cells = [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
             F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn")]
    c = df.groupBy(*keys).agg(*cells) if keys else df.agg(*cells)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return c.select(*keys, "tp", "fp", "fn", "tn", _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _div(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"))


#: most classes a confusion grid is made for
MAX_CLASSES = 1000


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts on the complete (label × prediction) grid of observed
    classes. One scan: the classes are read off the counted cells. A key with
    more than ``MAX_CLASSES`` values is refused (not a class)."""
    counts = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    both = counts.agg(F.collect_list(F.struct(label, pred, "n")).alias("cells"))
    cs = F.array_sort(F.array_distinct(F.flatten(F.transform("cells", lambda c: F.array(c[label], c[pred])))))
    both = both.withColumn("cs", F.filter(cs, lambda c: c.isNotNull()))
    both = both.withColumn("cs", F.when(F.size("cs") <= MAX_CLASSES, F.col("cs")).otherwise(
        F.raise_error(F.lit("too many classes for a confusion grid")).cast(both.schema["cs"].dataType)))
    grid = both.select("cells", "cs", F.explode("cs").alias(label)).select("cells", label, F.explode("cs").alias(pred))
    mine = F.filter("cells", lambda c: (c[label] == F.col(label)) & (c[pred] == F.col(pred)))
    return grid.select(label, pred, F.coalesce(F.get(mine, F.lit(0))["n"], F.lit(0)).alias("n"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class precision, recall, F1, support. Each row contributes
    to its true class (support, hit) and to its predicted class, so one
    generator + one aggregation gives every one-vs-rest cell."""
    y, p = F.col(label), F.col(pred)
    hit = F.coalesce(y == p, F.lit(False)).cast("long")
    rows = df.select(F.explode(F.array(
        F.struct(y.alias("cls"), F.lit(1).cast("long").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("tp")),
        F.struct(p.alias("cls"), F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("p"),
                 F.lit(0).cast("long").alias("tp")))).alias("r")).select("r.*")
    r = rows.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))
    prec, rec = _div(F.col("tp"), F.col("predicted")), _div(F.col("tp"), F.col("support"))
    return r.select("cls", prec.alias("precision"), rec.alias("recall"),
                    _div(F.lit(2) * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def weighted_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """E2 (+E6 averages): macro and support-weighted precision/recall/F1."""
    rep = class_report(df, label, pred)
    tot = F.sum("support").cast("double")
    return rep.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                   F.avg("f1").alias("macro_f1"),
                   F.try_divide(F.sum(F.col("precision") * F.col("support")), tot).alias("weighted_precision"),
                   F.try_divide(F.sum(F.col("recall") * F.col("support")), tot).alias("weighted_recall"),
                   F.try_divide(F.sum(F.col("f1") * F.col("support")), tot).alias("weighted_f1"))


#: ranges of a prefix sum: fixed, so plans do not follow the session's settings
PREFIX_RANGES = 256


def quantile_ranges(df: DataFrame, col: str, out: str, ranges: int) -> DataFrame:
    """Adds the number of the range of ``col`` (a double) among ``ranges`` cut at
    its quantiles: fewer numbers than ranges, fetched once and searched in halves.
    NaN and then missing values have ranges of their own, the last ones."""
    from pyspark.ml.feature import Bucketizer
    qs = [i / ranges for i in range(1, ranges)]
    found = (df.agg(F.percentile_approx(col, qs, 100 * ranges)).first()[0] or []) if qs else []
    bounds = sorted({b for b in found if abs(b) < float("inf")})
    if bounds:
        splits = [-float("inf"), *bounds, float("inf")]
        df = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
    else:
        df = df.withColumn(out, F.when(F.isnan(col), 1.0).when(F.col(col).isNotNull(), 0.0))
    return df.withColumn(out, F.coalesce(out, F.lit(float(ranges + 1))))


def ordered_prefix_sums(df: DataFrame, order: str, values: Sequence[str], descending: bool = False,
                        keys: Sequence[str] = (), ranges: int = PREFIX_RANGES) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order`` (within each
    ``keys`` group; one row per distinct (keys, order) value expected),
    computed range-parallel. The rows are written once, cut into ``ranges``
    ranges at quantiles of ``order``, summed per (keys, range) in
    parallel, and shifted by range offsets from a table with one row per
    (keys, range). A key holding most rows is thus spread over all ranges.
    Rows without an order value come last and are neighbours of each other, and
    a missing key is a key like any other: no row is lost."""
    keys = list(keys)
    key = (-F.col(order) if descending else F.col(order)).cast("double")
    r = quantile_ranges(cut_lineage(df.withColumn("__k", key)), "__k", "__b", ranges)
    w = Window.partitionBy(*keys, "__b").orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = r.groupBy(*keys, "__b").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    wo = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # ≤ ranges rows per key
    off = tot.select(*keys, "__b", *[F.coalesce(F.sum(f"t_{v}").over(wo), F.lit(0)).alias(f"o_{v}") for v in values])
    off = off.withColumnsRenamed({k: f"__o_{k}" for k in [*keys, "__b"]})
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys] + [F.col("__b") == F.col("__o___b")]
    out = r.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values}).join(off if keys else F.broadcast(off), same)
    return out.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"o_{v}") for v in values}).drop(
        "__b", "__k", "__o___b", *[f"__o_{k}" for k in keys], *[f"o_{v}" for v in values])


def score_groups(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Distinct scores with positive / negative counts (map-side combined)."""
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One ROC point per distinct score (threshold = score, predict
    positive when score ≥ threshold). Rows without a score are no points but
    count in the totals."""
    # one scan: rows without a score are grouped too, for the totals only
    g = cut_lineage(df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))
    pn = g.select(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar()
    c = ordered_prefix_sums(g.filter(F.col("score").isNotNull()), "score", ["pos", "neg"], descending=True).withColumn("__pn", pn)
    return c.select(F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    F.try_divide(F.col("cum_pos").cast("double"), F.col("__pn.P").cast("double")).alias("tpr"),
                    F.try_divide(F.col("cum_neg").cast("double"), F.col("__pn.N").cast("double")).alias("fpr"))


def auc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = (), ranges: int = PREFIX_RANGES) -> DataFrame:
    """ROC AUC with tie-averaged ranks (Mann–Whitney):
    Σ_s pos_s·(neg_below_s + neg_s/2) / (P·N)."""
    if keys:
        g = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
        c = ordered_prefix_sums(g, "score", ["neg"], keys=keys, ranges=ranges)
        below = F.col("cum_neg") - F.col("neg")
        return c.groupBy(*keys).agg(F.try_divide(
            F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0))),
            F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))
    g = score_groups(df, label, score)
    c = ordered_prefix_sums(g, "score", ["neg"], ranges=ranges)
    below = F.col("cum_neg") - F.col("neg")
    # undefined (NULL) when one class is absent
    return c.agg(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0))),
                              F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def auc_ovr_weighted(df: DataFrame, label: str, prob_cols: dict) -> DataFrame:
    """E5: one-vs-rest AUC per class, weighted by class support.
    ``prob_cols`` maps class value → probability column."""
    long = df.select(F.col(label), F.explode(F.array(*[
        F.struct(F.lit(k).alias("cls"), F.col(c).alias("score")) for k, c in prob_cols.items()])).alias("s")) \
        .select(label, "s.cls", "s.score").withColumn("y", (F.col(label) == F.col("cls")).cast("int"))
    per = auc(long, "y", "score", keys=["cls"])
    sup = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    j = per.join(sup, "cls")
    return j.agg(F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support").cast("double"))
                 .alias("auc_ovr_weighted"))


def threshold_grid(min_thresh: float = 0.20, max_thresh: float = 0.80, per_unit: int = 60) -> list[float]:
    """Grid rule of the calibration: ``int((max-min)·60)+1`` evenly spaced
    points from min to max (22 points from 0.45)."""
    k = max(2, int((max_thresh - min_thresh) * per_unit) + 1)
    return [float(x) for x in np.linspace(min_thresh, max_thresh, k)]


def threshold_f1(scored: DataFrame, thresholds: Sequence[float], fold: str = "fold", label: str = "label",
                 score: str = "score") -> DataFrame:
    """J7/ML11: F1 per (fold, threshold), predicting positive at score ≥ t.
    One pass: a conditional count per threshold and cell (no grid join)."""
    y, s = F.col(label), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((y == 1) & (s >= F.lit(t))).alias(f"tp{i}"),
                 F.count_if((y != 1) & (s >= F.lit(t))).alias(f"fp{i}"),
                 F.count_if((y == 1) & (s < F.lit(t))).alias(f"fn{i}")]
    one = scored.groupBy(fold).agg(*aggs)
    rows = one.select(fold, F.explode(F.array(*[
        F.struct(F.lit(i).alias("ti"), F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)
    ])).alias("s")).select(fold, "s.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumn("f1", _div(F.lit(2) * tp, F.lit(2) * tp + fp + fn))


def best_threshold(per_fold: DataFrame) -> DataFrame:
    """ML11: threshold with the highest mean F1 over folds; first (lowest)
    threshold on ties."""
    m = per_fold.groupBy("ti", "threshold").agg(F.round(F.avg("f1"), 12).alias("mean_f1"))
    return m.agg(F.min_by("threshold", F.struct(-F.col("mean_f1"), F.col("ti"))).alias("threshold"),
                 F.max("mean_f1").alias("mean_f1"))


def one_row(frames: Sequence[DataFrame]) -> DataFrame:
    """Combine one-row frames with distinct column names into one row:
    union by name (missing columns NULL) and take each column's non-null
    value in a single aggregation — no join."""
    from functools import reduce
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def train_test_gap(train_metrics: DataFrame, test_metrics: DataFrame,
                   metrics: Sequence[str] = ("accuracy", "f1")) -> DataFrame:
    """Train − test difference per metric (inputs: one row each)."""
    a = train_metrics.select(*[F.col(m).alias(f"train_{m}") for m in metrics])
    b = test_metrics.select(*[F.col(m).alias(f"test_{m}") for m in metrics])
    j = one_row([a, b])
    return j.withColumns({f"gap_{m}": F.col(f"train_{m}") - F.col(f"test_{m}") for m in metrics})


def metric_rows(named: dict[str, DataFrame]) -> DataFrame:
    """Union of one-row metric frames, tagged by model name."""
    from functools import reduce
    parts = [df.withColumn("model", F.lit(k)) for k, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
