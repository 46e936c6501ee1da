"""Mixing sources to target weights along a time-varying curriculum.

* Targets: sources ranked by code point (null last) weigh 5, 2, 1, repeating,
  and share ``budget`` times all words. A target stops at ``max_epochs`` times
  its source's words; what is over goes to the others by weight. The fixed
  point of that resharing is ``min(max_epochs * size, level * weight)`` for one
  common ``level``, found with prefix sums over the sources (one row each).
* Order: a source's documents stand in the order of a seeded digest. Cumulative
  words come from prefix sums inside (source, digest range) plus the offsets of
  the ranges, so a source with a third of all rows is spread over all ranges.
* Curriculum: each source's weight schedule is a piecewise-linear density over
  training time 0..1. Its integral is the share of the source's target consumed
  by then; a copy of a document that starts after ``q`` words of its source's
  demand is read at the time where the integral reaches ``q / target``. All
  sources' integrals at that time add up to the copy's training position in
  words, and the copies are range-sorted by it.

Defined results: a null or blank text has size 0 and is never taken; a null
source is a source of its own; rows with equal id and text are told apart only
by an arbitrary but fixed row number; empty table, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.llm.common import WORD, with_row, write_shared

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "curriculum-7"
#: weight schedules over training time, by position of the weight in WEIGHTS:
#: (time, density) knots, each with integral 1: early, steady and late sources
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: hex digits of the order digest that name a range: 4096 ranges a source
RANGE_DIGITS = 3


def _pieces(knots):
    """(t0, t1, density at t0, slope, integral before t0, integral before t1)."""
    area, out = 0.0, []
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        nxt = area + (a + b) / 2 * (t1 - t0)
        out.append((t0, t1, a, (b - a) / (t1 - t0), area, nxt))
        area = nxt
    return [(t0, t1, a / area, s / area, f0 / area, f1 / area) for t0, t1, a, s, f0, f1 in out]


def integral(knots, t: Column) -> Column:
    """Share of the demand consumed by time ``t``."""
    pieces = _pieces(knots)
    out = F.lit(1.0)
    for t0, t1, a, s, f0, _ in reversed(pieces):
        out = F.when(t < t1, F.lit(f0) + F.lit(a) * (t - t0) + F.lit(s / 2) * (t - t0) * (t - t0)).otherwise(out)
    return out


def inverse(knots, share: Column) -> Column:
    """Time by which ``share`` of the demand is consumed."""
    out = F.lit(1.0)
    for t0, _, a, s, f0, f1 in reversed(_pieces(knots)):
        rest = share - F.lit(f0)
        step = rest / F.lit(a) if s == 0 else (F.sqrt(F.lit(a * a) + F.lit(2 * s) * rest) - F.lit(a)) / F.lit(s)
        out = F.when(share < f1, F.lit(t0) + step).otherwise(out)
    return out


def source_targets(base: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, class, target)``, one row per source. The windows
    run over one row per source."""
    every = W.partitionBy()
    n = len(weights)
    src = (base.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("class", F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n)))
           .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("class") + 1))
           .withColumn("total", F.sum("source_size").over(every))
           .withColumn("cap", F.lit(max_epochs) * F.col("source_size")))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    src = (src.withColumn("left", F.lit(budget) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("w_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("free", F.col("left") * F.col("weight") / F.col("w_left") < F.col("cap"))
           .withColumn("nth", F.row_number().over(by_ratio)))
    # once one source stays under its cap, so do all after it: the first one sets the level
    first = F.min(F.when(F.col("free"), F.col("nth"))).over(every)
    src = src.withColumn("first", first)
    at = F.col("nth") == F.col("first")
    src = (src.withColumn("l_left", F.max(F.when(at, F.col("left"))).over(every))
           .withColumn("l_w", F.max(F.when(at, F.col("w_left"))).over(every)))
    return src.select("source", "source_size", "class",
                      F.when(F.col("nth") >= F.col("first"), F.col("l_left") * F.col("weight") / F.col("l_w"))
                      .otherwise(F.col("cap")).cast("double").alias("target"))


def curriculum_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
                    weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES,
                    seed: str = SEED, whole: bool = False, carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and
    ``copies``, an array of ``(epoch, words, time, position)``.

    The demand of a source ends inside some document. That document gives the
    words up to there, or with ``whole`` all its words if at least half of them
    are before the end, else none."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                            F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    base = with_row(docs, carry, uid=F.monotonically_increasing_id(), doc_id=F.col(id_col), source=F.col(source_col),
                    text=F.col(text_col))
    base = write_shared(base.withColumns({"size": size, "digest": digest}).drop("text")
                        .withColumn("range", F.substring("digest", 1, RANGE_DIGITS)), "mix-sizes")

    targets = source_targets(base, weights, budget, max_epochs)
    every = W.partitionBy()
    for i in range(len(weights)):  # demand of each schedule, the same on every row
        targets = targets.withColumn(f"demand{i}", F.sum(F.when(F.col("class") == i, F.col("target")).otherwise(0.0)).over(every))
    targets = write_shared(targets, "mix-targets")
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    cells = (ranges.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source"))
             .select(F.col("r.source").alias("c_source"), F.col("range").alias("c_range"), "offset", "source_size", "class",
                     "target", *[f"demand{i}" for i in range(len(weights))]))
    inside = W.partitionBy("source", "range").orderBy("digest", "uid").rowsBetween(W.unboundedPreceding, -1)
    d = (base.drop("row").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
         .join(cells, F.expr("source <=> c_source AND range = c_range"))
         .withColumn("start", F.col("offset") + F.col("inside"))
         .withColumn("goal", F.floor("target")))

    copies = []
    for epoch in range(max_epochs):
        begin = F.lit(epoch) * F.col("source_size") + F.col("start")
        if whole:
            words = F.when(2 * (F.col("goal") - begin) >= F.col("size"), F.col("size")).otherwise(0)
        else:
            words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - begin))
        share = begin / F.col("target")
        time = F.lit(1.0)
        for i, knots in enumerate(schedules):
            time = F.when(F.col("class") == i, inverse(knots, share)).otherwise(time)
        copies.append((words.cast("long"), time))
    for epoch, (words, time) in enumerate(copies):
        d = d.withColumns({f"words{epoch}": words,
                           f"time{epoch}": F.when((F.col("target") > 0) & (words > 0), time)})
    structs = []
    for epoch in range(max_epochs):
        position = F.lit(0.0)
        for i, knots in enumerate(schedules):
            position = position + F.col(f"demand{i}") * integral(knots, F.col(f"time{epoch}"))
        structs.append(F.struct(F.lit(epoch).alias("epoch"), F.col(f"words{epoch}").alias("words"),
                                F.col(f"time{epoch}").alias("time"), position.alias("position")))
    d = d.withColumn("copies", F.filter(F.array(*structs), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    d = d.select("uid", "doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")
    return d.join(base.select("uid", "row"), "uid") if carry else d  # whole rows move once


def curriculum_mix(docs: DataFrame, **kw) -> DataFrame:
    """The training stream: one row per copy taken, range-sorted by training
    ``position`` (the row number breaks ties)."""
    plan = curriculum_plan(docs, **kw)
    keep = [c for c in plan.columns if c != "copies"]
    stream = plan.select(*keep, F.explode("copies").alias("c")).select(*keep, "c.epoch", "c.words", "c.time", "c.position")
    return stream.repartitionByRange("position", "uid").sortWithinPartitions("position", "uid")


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """Per document: words taken and the training position of its first copy,
    documents range-sorted by that position."""
    plan = curriculum_plan(docs, **kw)
    first = F.floor(F.get(F.col("copies"), F.lit(0))["position"])
    return (plan.withColumn("first_position", first).repartitionByRange("first_position", "uid")
            .sortWithinPartitions("first_position", "uid")
            .select("doc_id", "size", "source_size", "target", "taken", "first_position"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class,
              sum(source_size) OVER () AS total, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, CASE class WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER r AS nth,
              1.5::DOUBLE * total - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS w_left
       FROM s2 WINDOW r AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
s4 AS (SELECT *, min(CASE WHEN lft::DOUBLE * weight / w_left < cap THEN nth END) OVER () AS first FROM s3),
s5 AS (SELECT *, max(CASE WHEN nth = first THEN lft END) OVER () AS l_left,
              max(CASE WHEN nth = first THEN w_left END) OVER () AS l_w FROM s4),
s6 AS (SELECT source, source_size, class,
              (CASE WHEN nth >= first THEN l_left::DOUBLE * weight / l_w ELSE cap END)::DOUBLE AS target FROM s5),
s AS (SELECT *, sum(CASE WHEN class = 0 THEN target ELSE 0 END) OVER () AS d0,
             sum(CASE WHEN class = 1 THEN target ELSE 0 END) OVER () AS d1,
             sum(CASE WHEN class = 2 THEN target ELSE 0 END) OVER () AS d2 FROM s6),
c AS (SELECT d.doc_id, d.size, s.*, floor(target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY digest
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT *, greatest(0, least(size, goal - start)) AS w0,
             greatest(0, least(size, goal - source_size - start)) AS w1, start / target AS u FROM c),
p AS (SELECT *, CASE WHEN w0 <= 0 THEN NULL
                     WHEN class = 0 THEN (sqrt(2.25 + -2.0 * u) - 1.5) / -1.0
                     WHEN class = 1 THEN u
                     ELSE (sqrt(0.25 + 2.0 * u) - 0.5) / 1.0 END AS tm FROM t)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
       floor(d0 * (1.5 * tm - 0.5 * tm * tm) + d1 * tm + d2 * (0.5 * tm + 0.5 * tm * tm))::BIGINT AS first_position
FROM p
"""
