"""Quality rules: a decision list learned from labelled statistics (SQL functions only).

* Statistics: one pass over whole texts, inside each row, no shuffle. Repeated
  three-word windows are found by sorting the row's own windows and comparing
  neighbours, so the cost is n log n for a text of n words and nothing leaves
  the row.
* Learning: sequential covering. Numeric features are cut at quantiles of the
  bad and of the good labelled rows. A rule for bad text is grown one threshold
  at a time by information gain over two thirds of the rows (one aggregation
  over feature bins per step; the driver reads counts, features x bins), pruned
  back on the other third to the shortest form of the best precision, and the
  rows it covers are removed before the next rule is grown.
* Verdict: the rules in order, as one ``CASE WHEN ... THEN FALSE`` expression.

The classifier is fitted on at most ``MAX_LABELLED`` labelled rows, chosen by a
hash of their id; every document is judged.

Defined results: null text has no words (base-failed); null or missing labels
are not used; without labelled rows of both kinds the list is empty and the base
conditions decide alone; empty table, empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import SPACE, WORD, with_row, write_shared

WINDOW_WORDS = 3
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: bound on the labelled rows a list is learned from
MAX_LABELLED = 100_000
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 4
#: quantile levels at which features are cut
LEVELS = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 1.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "words": "CAST(n_words AS double)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbols": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "dup_lines": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "repeats": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "capitals": "coalesce(try_divide(n_capitals, word_chars), 0D)",
    "shouts": "coalesce(try_divide(n_shouts, n_words), 0D)",
    "distinct": "coalesce(try_divide(n_distinct, n_words), 0D)",
}


def _count_chars(text: Column, chars: str) -> Column:
    """Characters of a class, counted by what deleting them takes away."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id``, the counts of the contract and those the features need."""
    text = F.col("text")
    d = with_row(docs, carry, doc_id=F.col(id_col), text=F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumns({
        "words": F.regexp_extract_all(text, F.lit(WORD), 0),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")),
        "n_symbols": _count_chars(text, "#*$%&|<>"),
        "n_capitals": _count_chars(text, r"\p{Lu}"),
        "n_shouts": _count_chars(text, "!?"),
    }).drop("text")
    d = d.withColumn("n_words", F.size("words"))
    # the row's windows with their places, in order of the words: equal windows become neighbours
    k = F.greatest(F.col("n_words") - (WINDOW_WORDS - 1), F.lit(0))
    parts = [F.slice("words", i + 1, k).alias(f"w{i}") for i in range(WINDOW_WORDS)]
    places = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("windows", F.sort_array(F.arrays_zip(*parts, places.alias("at"))))
    d = d.withColumns({
        "n_distinct": F.size(F.array_distinct("words")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "next": F.slice("windows", 2, F.greatest(F.size("windows"), F.lit(1))),
    }).drop("words", "lines")

    def same(a: Column, b: Column) -> Column:
        equal = a["w0"] == b["w0"]
        for i in range(1, WINDOW_WORDS):
            equal = equal & (a[f"w{i}"] == b[f"w{i}"])
        return F.when(equal, F.array(a["at"], b["at"]))
    d = d.withColumn("twice", F.zip_with("windows", "next", same)).drop("windows", "next")
    d = d.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(F.array_compact("twice"))))).drop("twice")
    # words covered: up to the next start, at most a window (least() passes over the null after the last)
    cover = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))),
                       lambda a, b: F.least(F.lit(WINDOW_WORDS), b - a))
    d = d.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0), lambda s, x: s + x)).drop("starts")
    counts = [*COUNTS, "n_lines", "n_capitals", "n_shouts", "n_distinct"]
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts], *(["row"] if carry else []))


def _cuts_below(cuts: list[float], value: Column) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda c: c < value))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained on the bad rows that stay covered."""
    if p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _rule_sql(rule: list[tuple[str, str, float]]) -> str:
    return " AND ".join(f"{f} {op} {v!r}D" for f, op, v in rule)


def learn(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[tuple[str, str, float]]]:
    """Ordered rules for bad text from rows ``(doc_id, bad boolean, features...)``."""
    names = list(FEATURES)
    # the sample is chosen by the hash of the id, so the same rows are taken in every run
    labelled = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "bad", *FEATURES).limit(max_labelled)
    quantiles = labelled.groupBy("bad").agg(*[
        F.percentile_approx(f, list(LEVELS), 10_000).alias(f) for f in names]).collect()  # two rows
    if len(quantiles) < 2:
        return []
    cuts = {f: sorted({float(v) for r in quantiles for v in r[f]}) for f in names}
    # bin b of a feature: exactly its first b cuts lie below the value
    bins = write_shared(labelled.select(
        "bad", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        *[_cuts_below(cuts[f], F.col(f)).alias(f) for f in names]).repartition(4), "rule-bins")

    def covered(rule):
        c = F.lit(True)
        for f, op, v in rule:
            b = cuts[f].index(v)
            c = c & ((F.col(f) > b) if op == ">" else (F.col(f) <= b))
        return c

    rules, rest = [], bins
    while len(rules) < MAX_RULES:
        rule: list[tuple[str, str, float]] = []
        grow, base = rest.where("NOT prune"), None
        while len(rule) < MAX_CONDITIONS:
            tall = grow.where(covered(rule)).select(
                "bad", F.explode(F.map_from_arrays(F.lit(names), F.array(*names))).alias("f", "b"))
            rows = tall.groupBy("f", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            hist = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in names}
            for r in rows:
                hist[r["f"]][r["b"]] = [r["p"], r["n"]]
            p0, n0 = (sum(h[i] for h in hist[names[0]]) for i in (0, 1))
            if p0 < MIN_COVER or n0 == 0:
                break
            best = (1e-9, None)
            for f in names:
                p = q = 0
                for b, (hp, hn) in enumerate(hist[f][:-1]):  # <= cut b, and > cut b
                    p, q = p + hp, q + hn
                    for op, pp, nn in (("<=", p, q), (">", p0 - p, n0 - q)):
                        if pp >= MIN_COVER and (g := _gain(pp, nn, p0, n0)) > best[0]:
                            best = (g, (f, op, cuts[f][b]))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # prune: the shortest form with the best precision on the rows held out
        # (on all rows where the rule meets none of those)
        forms = [rule[: i + 1] for i in range(len(rule))]
        held = rest.agg(*[F.count_if(side & kind & covered(r)).alias(f"{k}{s}{i}")
                          for i, r in enumerate(forms) for s, side in (("p", F.col("prune")), ("a", F.lit(True)))
                          for k, kind in (("b", F.col("bad")), ("g", ~F.col("bad")))]).first()
        s = "p" if held["bp0"] + held["gp0"] else "a"
        score = [(held[f"b{s}{i}"] + 1) / (held[f"b{s}{i}"] + held[f"g{s}{i}"] + 2) for i in range(len(forms))]
        i = max(range(len(forms)), key=lambda j: (score[j], -j))
        bad, seen = held[f"b{s}{i}"], held[f"b{s}{i}"] + held[f"g{s}{i}"]
        if not seen or bad / seen < MIN_PRECISION:
            break
        rules.append(forms[i])
        rest = rest.where(~covered(forms[i]))
    return rules


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The list as one conditional expression: true keeps the document."""
    case = " ".join(f"WHEN {_rule_sql(r)} THEN FALSE" for r in rules)
    return F.expr(f"CASE {case} ELSE TRUE END") if rules else F.lit(True)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  label_col: str = "quality", max_labelled: int = MAX_LABELLED, carry: bool = False) -> DataFrame:
    """Per document ``doc_id``, the counts, ``base_failed`` and ``kept`` (and ``row``)."""
    stats = write_shared(statistics(docs, id_col, text_col, carry), "quality-stats")
    feats = stats.withColumns({f: F.expr(e) for f, e in FEATURES.items()})
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), (F.col(label_col) == 0).alias("bad"))
    labelled = write_shared(feats.select("doc_id", *FEATURES).join(marked, F.col("doc_id") == F.col("l_id"))
                            .select("doc_id", "bad", *FEATURES), "quality-labelled")
    rules = learn(labelled, max_labelled)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    out = feats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", *(["row"] if carry else []))
