"""Declarative data constraints with stored, mergeable states.

A constraint is a row of at most six sums over a table and a rule that reads them.
All constraints of a table are compiled to one aggregate, so the table is scanned once.
Sums of disjoint rows add up: a state is stored with a folder per value of a partition
key (a year), a new year is aggregated by itself, and the verdicts are read from the
states without the rows.

Defined results: a condition that is NULL is not a violation, unless it says so itself;
correlations take the rows in which both values are present and not NaN; a correlation
or share that does not exist (no rows, no variance) passes with a NULL observation;
a missing partition key is a partition of its own. An empty table has no state rows, so
its constraints are listed by :func:`verdicts` with sums of zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["Constraint", "never", "at_least", "holds", "both_present", "same_share", "uncorrelated", "unique",
           "state", "write_state", "read_state", "merged", "verdicts"]

_SUMS = [f"s{i}" for i in range(1, 7)]
#: columns of a state that repeat its constraint's declaration
_DECLARED = {"section": "section", "check": "name", "rule": "rule", "limit": "limit"}


@dataclass(frozen=True)
class Constraint:
    section: str
    name: str
    rule: str
    limit: float = 0.0
    terms: tuple[Column, ...] = ()
    keys: tuple[str, ...] = field(default=())


def _one(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def never(section: str, name: str, condition: Column) -> Constraint:
    """No row fulfils ``condition``; observed: how many do."""
    return Constraint(section, name, "zero", 0.0, (_one(condition),))


def holds(section: str, name: str, fact: bool) -> Constraint:
    """A fact known from the schema (a column, its type); observed: the rows stored
    while it did not hold."""
    return never(section, name, F.lit(not fact))


def at_least(section: str, name: str, condition: Column, rows: int = 1) -> Constraint:
    """At least ``rows`` rows fulfil ``condition``."""
    return Constraint(section, name, "at least", float(rows), (_one(condition),))


def both_present(section: str, name: str, condition: Column) -> Constraint:
    """Some rows fulfil ``condition`` and some its opposite; observed: the fewer ones."""
    return Constraint(section, name, "both", 1.0, (_one(condition), _one(~condition)))


def same_share(section: str, name: str, part: Column, condition: Column, limit: float) -> Constraint:
    """The share of ``condition`` inside ``part`` and outside differs by ``limit`` at most."""
    return Constraint(section, name, "shares", limit, (_one(part & condition), _one(part), _one(~part & condition), _one(~part)))


def uncorrelated(section: str, name: str, x: str, y: str, limit: float, centre: tuple[float, float] = (0.0, 0.0)) -> Constraint:
    """``|corr(x, y)| <= limit``. Sums are taken about ``centre``, a constant near the
    values (5 for scores from 0 to 10), which keeps their digits and lets them add up."""
    a, b = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) - F.lit(float(m)) for c, m in zip((x, y), centre))
    there = a.isNotNull() & b.isNotNull()
    terms = tuple(F.when(there, t).otherwise(F.lit(0.0)) for t in (F.lit(1.0), a, b, a * a, b * b, a * b))
    return Constraint(section, name, "correlation", limit, terms)


def unique(section: str, name: str, keys: Sequence[str]) -> Constraint:
    """No two rows share ``keys``; observed: values of the keys that several rows have
    (missing ones included). States only add up if equal keys lie in one partition, so
    the partition key must be one of them."""
    return Constraint(section, name, "zero", 0.0, (), tuple(keys))


def state(df: DataFrame, constraints: Sequence[Constraint], key: str) -> DataFrame:
    """One row per (partition, constraint): ``key, section, check, rule, limit, s1…s6``.
    With a uniqueness constraint the sums are first taken per key value, in the same
    pass, combined map-side like the second step, so a repeated key is one row."""
    sums = {(i, j): t for i, c in enumerate(constraints) for j, t in enumerate(c.terms)}
    keys = {c.keys for c in constraints if c.keys}
    if len(keys) > 1:
        raise ValueError("one uniqueness key per table: a second one needs a state of its own")
    if len({(c.section, c.name) for c in constraints}) < len(constraints):
        raise ValueError("two constraints of a section have one name")
    names = {k: f"__{k[0]}_{k[1]}" for k in sums}
    firsts = [F.sum(t).alias(names[k]) for k, t in sums.items()]
    if keys:
        by = list(next(iter(keys)))
        if key not in by:
            raise ValueError(f"unique keys {by} do not include the partition key {key}")
        df = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), *firsts)
        firsts = [F.sum(n).alias(n) for n in names.values()]
    total = df.groupBy(key).agg(*([F.sum(_one(F.col("__rows") > 1)).alias("__twice")] if keys else []), *firsts)

    at = F.col("__i")
    sums_of = [F.array(F.col("__twice")) if c.keys else F.array(*[F.col(names[i, j]) for j in range(len(c.terms))])
               for i, c in enumerate(constraints)]
    each = total.select(key, F.posexplode(F.array(*sums_of)).alias("__i", "__s"))
    said = [F.element_at(_literals(constraints, n), at + 1).alias(n) for n in _DECLARED]
    return each.select(key, *said, *[F.coalesce(F.get("__s", F.lit(j)), F.lit(0.0)).alias(n) for j, n in enumerate(_SUMS)])


def _literals(constraints: Sequence[Constraint], declared: str) -> Column:
    return F.lit([getattr(c, _DECLARED[declared]) for c in constraints])


def write_state(df: DataFrame, constraints: Sequence[Constraint], key: str, path: str) -> None:
    """Aggregate the rows of ``df`` and store them, a folder per value of ``key``; other
    values' folders stay as they are, a value that is there already is replaced."""
    (state(df, constraints, key).repartition(1, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(states: DataFrame) -> DataFrame:
    """States of disjoint rows added up. Constraints are rows of constants, so a check
    whose limit was changed between two partitions counts as two."""
    return states.groupBy("section", "check", "rule", "limit").agg(*[F.sum(s).alias(s) for s in _SUMS])


def verdicts(total: DataFrame, constraints: Sequence[Constraint], digits: int = 6) -> DataFrame:
    """``section, check, passed, observed`` of merged states, every one of
    ``constraints`` included, those without a stored row too."""
    spark = total.sparkSession
    listed = spark.range(1).select(F.inline(F.arrays_zip(*[_literals(constraints, n).alias(n) for n in _DECLARED])).alias(*_DECLARED))
    t = total.join(listed, list(_DECLARED), "right")
    s1, s2, s3, s4, s5, s6 = (F.coalesce(F.col(s), F.lit(0.0)) for s in _SUMS)
    r = F.try_divide(s1 * s6 - s2 * s3, F.sqrt(F.greatest(s1 * s4 - s2 * s2, F.lit(0.0))) * F.sqrt(F.greatest(s1 * s5 - s3 * s3, F.lit(0.0))))
    rule, limit = F.col("rule"), F.col("limit")
    observed = (F.when(rule == "shares", F.round(F.abs(F.try_divide(s1, s2) - F.try_divide(s3, s4)), digits))
                .when(rule == "correlation", F.round(F.abs(r), digits)).when(rule == "both", F.least(s1, s2)).otherwise(s1))
    passed = F.when(rule.isin("at least", "both"), observed >= limit).otherwise(F.coalesce(observed <= limit, F.lit(True)))
    return t.select("section", "check", passed.alias("passed"), observed.alias("observed"))
