import math

import pytest

from panelkit.llm import toxicity
from panelkit.llm.common import documents
from tests.llm.fixtures import SF, empty, rows, tricky


def test_chain_held_out(spark):
    """Fitted on two thirds of the labels, the chain finds the toxic rows among the others and leaves clean ones alone."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    out = (toxicity.toxicity(documents(spark, sf), fit).withColumnRenamed("toxic", "guess").join(held, "doc_id")
           .select("guess", "toxic").collect())
    toxic = [r.guess for r in out if r.toxic == 1]
    clean = [r.guess for r in out if r.toxic == 0]
    assert len(toxic) > 100 and sum(toxic) >= 0.85 * len(toxic)
    assert sum(clean) <= 0.02 * len(clean)


def test_scorer_equals_the_model_by_hand():
    models = [{"name": "a", "weights": {}, "before": [], "intercept": -0.5, "threshold": 0.5},
              {"name": "b", "weights": {}, "before": [2.0], "intercept": 0.1, "threshold": 0.5}]
    cols = toxicity.columns_of("idiotic!!")
    models[0]["weights"] = {cols[0]: 1.5, cols[1]: 0.25}
    models[1]["weights"] = {cols[-1]: -0.75}
    got = toxicity.Scorer(models).score("Idiotic!! idiotic!! other")
    pa = 1 / (1 + math.exp(-(-0.5 + 1.75)))
    pb = 1 / (1 + math.exp(-(0.1 - 0.75 + 2.0 * pa)))
    assert got == pytest.approx([pa, pb])
    assert toxicity.Scorer(models).score(None) == pytest.approx([1 / (1 + math.exp(0.5)), 1 / (1 + math.exp(-(0.1 + 2 / (1 + math.exp(0.5)))))])


def test_sample_is_bounded_and_the_same_each_time(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    ids = [sorted(r.doc_id for r in toxicity.labelled_sample(docs, labels, "doc_id", "text", toxicity.CHAIN, 40, 3).collect())
           for _ in range(2)]
    assert ids[0] == ids[1] and 10 <= len(ids[0]) <= 40


def test_one_sided_and_missing_labels(spark):
    """Without both kinds of labels a category is certain; null labels are passed over."""
    schema = "doc_id long, quality int, toxic int"
    clean = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(3, None, 1), (None, 1, 1)], schema)
    out = toxicity.toxicity(tricky(spark), clean, carry=True).collect()
    assert len(out) == len(rows()) and not any(r.toxic or r.low_quality or r.toxic_low_quality for r in out)
    none = toxicity.toxicity(tricky(spark), clean.limit(0)).collect()
    assert len(none) == len(rows()) and not any(r.toxic for r in none)


def test_both_kinds_on_tricky_rows_and_empty_table(spark):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(20)], schema)
    out = toxicity.toxicity(tricky(spark), labels).collect()
    assert len(out) == len(rows())
    assert all(0 <= r[f"p_{n}"] <= 1 for r in out for n, _ in toxicity.CHAIN)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
