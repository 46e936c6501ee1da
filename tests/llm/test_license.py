import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelkit.llm import license as L
from panelkit.llm.common import documents
from tests.llm.fixtures import SF, empty, rows, tricky


def _cosine(text, template):
    """By hand, over all words."""
    idf, unknown, _ = L.template_weights()
    a, b = ({w: n * idf.get(w, unknown) for w, n in Counter(L.tokens(t)).items()} for t in (text, template))
    if not a:
        return 0.0
    dot = sum(x * b.get(w, 0) for w, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values()))


def _brute(files):
    """(path, licence, found, score, dir) of ``(path, text)`` pairs, by comparing everything with everything."""
    own, dirs = {}, {}
    for n, (path, text) in enumerate(files):
        parts = [(True, text or "")] + [(False, x) for x in (text or "").split("\n")]
        best, is_file = None, bool(re.match(L.LICENCE_NAMES, path.split("/")[-1].lower()))
        for body, part in parts:
            scored = [(-round(_cosine(part, t), 6), lic) for lic, t in L.TEMPLATES]
            neg, lic = min(scored)
            if -neg >= L.THRESHOLD:
                best = min(best or (neg, lic), (neg, lic))
                is_file |= body
        if best:
            own[n] = best
            if is_file:
                d = path.rpartition("/")[0]
                dirs[d] = min(dirs.get(d, (*best, path)), (*best, path))
    out = []
    for n, (path, _) in enumerate(files):
        if n in own:
            out.append((path, own[n][1], "own", -own[n][0], None))
            continue
        d = path
        while True:
            up = d.rpartition("/")[0]
            if up in dirs:
                out.append((path, dirs[up][1], "inherited", -dirs[up][0], up))
                break
            if not up:
                out.append((path, None, None, None, None))
                break
            d = up
    return out


def _same(got, want):
    assert Counter(got) == Counter(want)


def test_files_and_inheritance(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    files = [("LICENSE", mit), ("a/x.py", "code code"), ("a/b/COPYING.txt", "some words\nLicensed under the Apache License, Version 2.0"),
             ("a/b/c/d/y.py", None), ("a/b/z.py", "# Released under the MIT License.\nimport os"), ("a/bb/q.py", "public license of words"),
             ("a/e/t.md", "All rights reserved"), ("a/e/u.md", "x"), ("a/e/f/v.md", ""), ("top.txt", "word"),
             ("a/e/w.md", "All rights reserved.\n" + "word " * 500), ("a/b/c/d/y.py", None)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, file string, text string")
    got = [(r.path, r.licence, r.found, r.score, r.licence_dir) for r in L.license_scan(df, F.col("file")).collect()]
    _same(got, _brute(files))
    by = {p: (lic, d) for p, lic, _, _, d in got}
    assert by["a/x.py"] == ("MIT", "") and by["a/b/c/d/y.py"] == ("Apache-2.0", "a/b") and by["a/e/f/v.md"] == ("proprietary", "a/e")


@pytest.mark.parametrize("make", [lambda s: documents(s, SF), tricky])
def test_documents_brute_force(spark, make):
    docs = make(spark)
    data = docs.select(L.document_path().alias("path"), "text").collect()
    got = [(r.path, r.licence, r.found, r.score, r.licence_dir) for r in L.license_scan(docs, L.document_path()).collect()]
    _same(got, _brute([(r.path, r.text) for r in data]))


def test_without_key_words_no_template_is_reached():
    _, _, weights = L.template_weights()
    keys = set(L.key_words(weights, L.THRESHOLD))
    for i in {w[0] for w in weights}:
        assert math.sqrt(sum(x * x for j, _, w, x in weights if j == i and w not in keys)) < L.THRESHOLD


def test_every_template_finds_itself(spark):
    df = spark.createDataFrame([(i, f"d{i}/f", "left words here\n" + t + "\nright words") for i, (_, t) in enumerate(L.TEMPLATES)],
                               "doc_id long, file string, text string")
    got = {r.doc_id: (r.licence, r.score) for r in L.license_scan(df, F.col("file")).collect()}
    assert all(got[i] == (lic, 1.0) for i, (lic, _) in enumerate(L.TEMPLATES))


def test_empty_and_carry(spark):
    assert L.license_scan(empty(spark), L.document_path()).count() == 0
    out = L.license_scan(tricky(spark), L.document_path(), carry=True).collect()
    assert len(out) == len(rows()) and all(r.row.doc_id == r.doc_id for r in out)
