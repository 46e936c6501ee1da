from collections import Counter

import corpus_pipeline as P
from panelkit.llm.common import documents
from panelkit.llm.queries import tokenizer_path
from tests.llm.fixtures import SF, empty, tricky
from tests.llm.test_dedup_mix_shard import _targets
from tests.llm.test_text_operators import _components, _fingerprint, _stats


def _norm(t):
    import re
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def _stages(spark, docs):
    """Every stage's input and output rows, written and reread in between as run() does."""
    from panelkit.llm.common import shared_path
    out = []
    for name, stage in P.STAGES:
        path = shared_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs.collect(), new.collect(), docs.columns, new.columns))
        docs = new
    return out


def _check(stages):
    (_, d0, d1, c0, c1), (_, _, d2, _, c2), (_, _, d3, _, c3), (_, _, d4, _, c4), (_, _, d5, _, c5) = stages
    assert c0 == c1 == c2 == c3 == c4 and set(c4) <= set(c5)
    # quality: all that pass the base conditions stay unless a learned rule rejects them
    failed = lambda t: (lambda n, _a, _b, _c, rep: n < 50 or 100 * rep > 50 * n)(*_stats(t))
    assert not Counter(d1) - Counter(d0) and not any(failed(r.text) for r in d1)
    # exact: one row of each text
    assert not Counter(d2) - Counter(d1) and {_norm(r.text) for r in d2} == {_norm(r.text) for r in d1}
    assert len(d2) == len({_norm(r.text) for r in d1})
    # near: one document of each component
    comp = {}
    for d, _, c in _components([(r.doc_id, _fingerprint(r.text)) for r in d2]):
        comp[d] = c
    assert Counter(r.doc_id for r in d3) == Counter(set(comp.values()))
    # mixing: whole copies, at most two, near the targets
    sizes = Counter()
    for r in d3:
        sizes[r.source] += _stats(r.text)[0]
    got = Counter()
    for r in d4:
        got[r.source] += _stats(r.text)[0]
    largest = max((_stats(r.text)[0] for r in d3), default=0)
    assert all(abs(got[s] - t) <= largest / 2 for s, t in _targets(sizes).items())
    assert max(Counter(d4).values(), default=0) <= 2 and set(d4) <= set(d3)
    # tokens: the library's ids
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    assert Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in d4) == \
        Counter((r.doc_id, tuple(r.ids)) for r in d5)


def test_pipeline_stage_by_stage(spark):
    _check(_stages(spark, documents(spark, SF)))


def test_pipeline_run_equals_its_stages(spark):
    got = P.run(spark, SF)
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == \
        Counter((r.doc_id, r.n_tokens) for r in _stages(spark, documents(spark, SF))[-1][2])


def test_pipeline_tricky_and_empty(spark):
    stages = _stages(spark, tricky(spark))
    _check(stages)
    assert all(not out for _, _, out, _, _ in _stages(spark, empty(spark)))
