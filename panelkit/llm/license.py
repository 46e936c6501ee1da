"""License scans by sparse TF-IDF cosine to templates, with directory inheritance
(SQL functions only).

* Every line of every file, and the body as a whole, is a bag of words weighted by
  term count times inverse document frequency over the templates; words that no
  template has weigh as much as the rarest. A file's own licence is that of the
  template with the highest cosine over its lines and body, if at least
  ``THRESHOLD``; a file whose body as a whole reaches it is a licence file of its
  directory. Files named like one count by their best line.
* Only lines that hold a key word are compared. The key words are chosen so that
  the other words of any template cannot reach the threshold: without key words
  the cosine is at most the share of the template's length that is left, which is
  below it. The scan for key words therefore loses nothing.
* A bag of n words, v of them known to the templates, has a cosine of at most
  v / sqrt(n - v): unknown words weigh most and each counts at least once. Bags
  below the threshold by this bound are not unfolded.
* Equal lines are compared once: a notice in a third of all files is one row.
* A file without a licence of its own takes that of the nearest ancestor directory
  with a licence file: directories are taken once, unfolded into their ancestors
  (as many as a path is deep) and joined to the licensed directories.

Defined results: null texts have no licence of their own but inherit; null path
parts read ``_``; ties go to the higher score, then the first licence by name,
then the first path; empty table, empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import with_row, write_shared

THRESHOLD = 0.7
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: words that tell nothing about a licence; they are left out of all bags
STOP_WORDS = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "if", "in", "is", "it", "may", "not",
              "of", "on", "or", "that", "the", "this", "to", "with", "you", "your")
#: template words that are everyday words of another language; key words only if no others do
EVERYDAY = ("mit",)
#: names of licence files (last part of a path, lower case)
LICENCE_NAMES = r"^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
#: short notices and opening sentences of common licences
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
)


def tokens(text: str) -> list[str]:
    return [w for w in re.findall(TOKEN, text.lower()) if w not in STOP_WORDS]


def template_weights(templates=TEMPLATES) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """Inverse document frequencies, that of an unknown word, and rows
    ``(template, licence, term, weight)`` of templates scaled to length 1."""
    bags = [Counter(tokens(t)) for _, t in templates]
    df = Counter(w for b in bags for w in b)
    n = len(templates)
    idf = {w: math.log(1 + n / d) for w, d in df.items()}
    rows = []
    for i, ((licence, _), bag) in enumerate(zip(templates, bags)):
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in sorted(bag.items())))
        rows += [(i, licence, w, c * idf[w] / norm) for w, c in sorted(bag.items())]
    return idf, math.log(1 + n), rows


def key_words(rows: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Words such that every template keeps a length below ``threshold`` without them."""
    templates: dict[int, dict[str, float]] = {}
    for i, _, w, x in rows:
        templates.setdefault(i, {})[w] = x
    holders = Counter(w for t in templates.values() for w in t)
    chosen: set[str] = set()
    for t in templates.values():
        def rest(t=t):
            return math.sqrt(sum(x * x for w, x in t.items() if w not in chosen))
        # words of several templates do for all of these
        for w in sorted(t, key=lambda w: (w not in chosen, w in EVERYDAY, -t[w] * t[w] * holders[w], -len(w), w)):
            if rest() < threshold * 0.999:
                break
            chosen.add(w)
    return sorted(chosen)


def bag_key(text: Column) -> Column:
    """The words of a text, as one string."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    return F.array_join(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), " ")


def score_keys(keys: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Best template of every ``key`` (words joined by spaces): ``key, licence, score``."""
    spark = keys.sparkSession
    idf, unknown, rows = template_weights(templates)
    idf_df = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))  # fixed size: the templates
    t_df = F.broadcast(spark.createDataFrame(rows, "template int, licence string, term string, weight double"))
    bag = (keys.select(F.sha2("key", 256).alias("id"), F.explode(F.split("key", " ")).alias("term"))
           .groupBy("id", "term").agg(F.count("*").alias("tf")))
    bag = bag.join(idf_df, "term", "left").select("id", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    bag = write_shared(bag, "license-bags")
    norms = bag.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = bag.join(t_df, "term").groupBy("id", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, "id").select("id", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("licence"))).alias("b"))
    return best.select("id", F.col("b.licence").alias("licence"), (-F.col("b.neg")).alias("score"))


def license_scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES,
                 threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """Per file ``doc_id, path, licence, found`` (``own`` or ``inherited``), ``score``
    and ``licence_dir`` (the directory it was inherited from)."""
    _, _, rows = template_weights(templates)
    keys = "|".join(key_words(rows, threshold))
    has_key = rf"(?<![a-z0-9])(?:{keys})(?![a-z0-9])"  # a token may go on after - or ., the scan then finds more
    store = write_shared(with_row(files, carry, uid=F.monotonically_increasing_id(), doc_id=F.col(id_col), path=path,
                                  text=F.when(F.lower(F.col(text_col)).rlike(has_key), F.col(text_col))), "license-files")
    # only texts with a key word are left in the store
    bags = store.where("text IS NOT NULL").select("uid", "path", F.explode(F.concat(
        F.array(F.struct(F.lit(True).alias("body"), F.col("text").alias("part"))),
        F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(False).alias("body"), x.alias("part"))))).alias("p"))
    bags = bags.where(F.col("p.body") | F.lower(F.col("p.part")).rlike(has_key)).select(
        "uid", "path", "p.body", bag_key(F.col("p.part")).alias("key"))
    known = sorted({w for _, _, w, _ in rows})
    bags = bags.withColumn("words", F.split("key", " "))
    v = F.size(F.filter("words", lambda w: w.isin(*known)))
    bags = bags.where(v * v >= threshold * threshold * (F.size("words") - v)).drop("words")
    bags = write_shared(bags.withColumn("id", F.sha2("key", 256)), "license-parts")
    scores = write_shared(score_keys(bags.select("key").distinct(), templates).where(F.col("score") >= threshold), "license-scores")
    hits = bags.select("uid", "path", "body", "id").join(scores, "id")
    named = F.regexp_extract(F.lower(F.substring_index("path", "/", -1)), LICENCE_NAMES, 0) != ""
    own = hits.groupBy("uid", "path").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("licence"))).alias("b"),
                                         (F.max("body") | named).alias("is_file"))
    own = write_shared(own.select("uid", "path", "is_file", F.col("b.licence").alias("licence"), (-F.col("b.neg")).alias("score")),
                       "license-own")

    def folder(p: str) -> Column:
        """A path without its last part; empty at the top."""
        return F.regexp_replace(p, "/?[^/]*$", "")
    dirs = (own.where("is_file").groupBy(folder("path").alias("licence_dir"))
            .agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("licence"), F.col("path"))).alias("b"))
            .select("licence_dir", F.col("b.licence").alias("d_licence"), (-F.col("b.neg")).alias("d_score")))
    # all directories once, each with its ancestors, itself first
    parts = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("licence_dir"))),
        F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("licence_dir"))))
    tree = store.select(folder("path").alias("dir")).distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    near = (tree.join(dirs, "licence_dir").groupBy("dir")
            .agg(F.max(F.struct("depth", "licence_dir", "d_licence", "d_score")).alias("n")).select("dir", "n.*").drop("depth"))
    mine = own.select("uid", "licence", "score")
    need = ["uid", "doc_id", "path"] + (["row"] if carry else [])
    out = (store.select(*need, folder("path").alias("dir")).join(mine, "uid", "left").join(near, "dir", "left"))
    has = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("licence", "d_licence").alias("licence"),
        F.when(has, "own").when(F.col("d_licence").isNotNull(), "inherited").alias("found"),
        F.coalesce("score", "d_score").alias("score"), F.when(~has, F.col("licence_dir")).alias("licence_dir"),
        *(["row"] if carry else []))


def document_path() -> Column:
    """Documents have no path of their own: source, language and id stand for one."""
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id")])


def _sql() -> str:
    idf, unknown, rows = template_weights()
    idf_rows = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    t_rows = ", ".join(f"({i}, '{lic}', '{w}', {x!r}::DOUBLE)" for i, lic, w, x in rows)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH idf(term, idf) AS (VALUES {idf_rows}),
t(template, licence, term, weight) AS (VALUES {t_rows}),
f AS (SELECT row_number() OVER () AS uid, doc_id, text,
             coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(doc_id::VARCHAR, '_') AS path FROM documents),
parts AS (SELECT uid, TRUE AS body, text AS part FROM f
          UNION ALL SELECT uid, FALSE, unnest(string_split(text, chr(10))) FROM f),
keyed AS (SELECT uid, body, array_to_string(list_filter(regexp_extract_all(lower(part), '{TOKEN}'),
                     lambda w: w NOT IN ({stop})), ' ') AS key FROM parts),
keys AS (SELECT DISTINCT key FROM keyed WHERE key <> ''),
bag AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(string_split(key, ' ')) AS term FROM keys) GROUP BY key, term),
wt AS (SELECT key, bag.term, tf * coalesce(idf, {unknown!r}::DOUBLE) AS w FROM bag LEFT JOIN idf ON bag.term = idf.term),
norms AS (SELECT key, sqrt(sum(w * w)) AS norm FROM wt GROUP BY key),
dots AS (SELECT key, template, licence, sum(w * weight) AS dot FROM wt JOIN t ON wt.term = t.term GROUP BY key, template, licence),
scores AS (SELECT dots.key, licence, round(dot / norm, 6) AS score FROM dots JOIN norms ON dots.key = norms.key),
best AS (SELECT key, licence, score FROM scores WHERE score >= {THRESHOLD}
         QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, licence) = 1),
hits AS (SELECT uid, body, licence, score FROM keyed JOIN best ON keyed.key = best.key),
own AS (SELECT uid, licence, score, bool_or(body) OVER (PARTITION BY uid) AS is_file,
               row_number() OVER (PARTITION BY uid ORDER BY score DESC, licence) AS rn FROM hits),
mine AS (SELECT f.uid, f.path, own.licence, own.score, own.is_file FROM own JOIN f ON own.uid = f.uid WHERE rn = 1),
dirs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, score FROM mine WHERE is_file
         QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, licence, path) = 1),
tree AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM f),
above AS (SELECT dir, dir AS up, 2 AS depth FROM tree UNION ALL SELECT dir, regexp_replace(dir, '/[^/]*$', ''), 1 FROM tree
          UNION ALL SELECT dir, '', 0 FROM tree),
near AS (SELECT above.dir, up, licence, score FROM above JOIN dirs ON above.up = dirs.dir
         QUALIFY row_number() OVER (PARTITION BY above.dir ORDER BY depth DESC) = 1)
SELECT f.doc_id, f.path, coalesce(mine.licence, near.licence) AS licence,
       CASE WHEN mine.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' END AS found,
       coalesce(mine.score, near.score) AS score, CASE WHEN mine.licence IS NULL THEN near.up END AS licence_dir
FROM f LEFT JOIN mine ON f.uid = mine.uid LEFT JOIN near ON regexp_replace(f.path, '/[^/]*$', '') = near.dir
"""


SQL = _sql()
