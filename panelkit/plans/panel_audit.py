"""The full audit of the panel pipeline (R19): 12 sections of constraints over the raw
table, the panel, the model matrix, its split and its folds, each table scanned once and
its states stored by year (:mod:`panelkit.operators.constraints`).

Raw rows, panel and matrix are audited a year at a time: a new year is aggregated by
itself. A split and its folds are drawn from all rows, so their states are stored anew
whenever they are redrawn.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from panelkit import config as C
from panelkit.operators import constraints as K
from panelkit.operators.constraints import Constraint, at_least, both_present, holds, never, same_share, unique, uncorrelated
from panelkit.plans.features import LAG_FEATURES, excluded_inputs
from panelkit.plans.panel import INDICATORS

__all__ = ["raw_constraints", "panel_constraints", "matrix_constraints", "split_constraints", "fold_constraints",
           "store", "report"]

#: columns that every panel row must have; numeric ones; those with a range from 0 to 10
KEY_COLUMNS = ["entity_id", "yr", "tier", "gender", "institution", "segment", "phase", "tenure", "lag", "inde"]
NUMERIC = [*INDICATORS, "lag", "tenure"]
RANGED = [*INDICATORS, "ipv_n", "phase"]
#: features whose residual correlation with the target is watched
WATCHED = ["IAA", "IEG", "IPS", "IDA", "IPV", "FASE", "ANOS_PM", "GENERO_NUM", "PV_NUM"]


def _numeric(df: DataFrame, column: str) -> bool:
    kind = {f.name: f.dataType for f in df.schema.fields}.get(column)
    return isinstance(kind, NumericType) and not isinstance(kind, DecimalType)


def raw_constraints(raw: DataFrame, expected: dict[str, str]) -> list[Constraint]:
    """Section 1: rows, columns and types of the raw table."""
    have, s = dict(raw.dtypes), "raw data"
    return [at_least(s, "rows", F.lit(True)), holds(s, "columns", set(expected) <= set(have)),
            holds(s, "types", all(have.get(c) == t for c, t in expected.items()))]


def panel_constraints(p: DataFrame, years: tuple[int, int]) -> list[Constraint]:
    """Sections 2–7: what the loader promises, nulls, types, ranges, tenure, encodings."""
    col, (first, last) = F.col, years
    tiers = [*C.TIER_ORDER, C.TIER_MISSING]
    code = F.coalesce(*[F.when(col("tier") == t, F.lit(i + 1)) for i, t in enumerate(C.TIER_ORDER)], F.lit(0))
    load = "loader"
    loader = [unique(load, "one row per entity and year", ["entity_id", "yr"]),
              never(load, "year in the stated years", ~col("yr").between(first, last)),
              never(load, "tier spelling", ~col("tier").isin(*tiers)),
              never(load, "missing tier has no index", (col("tier") == C.TIER_MISSING) != col("inde").isNull()),
              never(load, "phase read from its code", ~col("phase").eqNullSafe(F.regexp_extract("phase_code", r"^(\d+)", 1).try_cast("int"))),
              never(load, "turning point is Sim, Não or missing", ~col("pv").isin("Sim", "Não")),
              holds(load, "columns added", {"tier_ord", "tenure", "phase"} <= set(p.columns)),
              *[never(load, f"{c} holds no NaN", F.isnan(c)) for c in INDICATORS]]
    return [*loader,
            *[never("nulls in key columns", c, col(c).isNull()) for c in KEY_COLUMNS],
            *[holds("numeric types", c, _numeric(p, c)) for c in NUMERIC],
            *[never("ranges", c, (col(c) < 0) | (col(c) > 10)) for c in RANGED],
            never("tenure", "not negative", col("tenure") < 0),
            never("tenure", "not longer than the panel", col("tenure") > col("yr") - F.lit(first)),
            never("encodings", "gender known", ~col("gender").isin("Menina", "Menino")),
            both_present("encodings", "both genders", col("gender") == "Menino"),
            never("encodings", "tier code follows the tier", F.coalesce("tier_ord", F.lit(0)) != code),
            never("encodings", "no code without a tier", col("tier_ord").isNotNull() & col("inde").isNull()),
            both_present("encodings", "both turning-point values", col("pv") == "Sim"),
            never("encodings", "turning point missing only without its score", col("pv").isNull() & (col("ipv") > 0))]


def matrix_constraints(m: DataFrame, limit: float = 0.5, features: Sequence[str] = LAG_FEATURES) -> list[Constraint]:
    """Sections 8–10: the target, the features and what they say about the target."""
    s = "features without leakage"
    return [never("binary target", "0 or 1", ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))),
            both_present("binary target", "both classes", F.col("label") == 1),
            *[never(s, c, F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in features],
            holds(s, "no excluded input", not excluded_inputs()),
            *[uncorrelated("residual leakage", c, c, "label", limit, (5.0, 0.5)) for c in WATCHED]]


def split_constraints(limit: float = 0.01) -> list[Constraint]:
    """Section 11 (J8): no row in both parts, equal class shares."""
    return [unique("split", "no row in both parts", ["entity_id", "yr"]),
            same_share("split", "stratified", F.col("is_test") == 1, F.col("label") == 1, limit)]


def fold_constraints(folds: int = 5, limit: float = 0.01) -> list[Constraint]:
    """Section 12: every row in one fold, no fold empty, equal class shares."""
    s = "cross-validation"
    return [unique(s, "every row once", ["entity_id", "yr"]),
            never(s, "fold known", ~F.coalesce(F.col("fold").between(0, folds - 1), F.lit(False))),
            *[at_least(s, f"fold {i} has rows", F.col("fold") == i) for i in range(folds)],
            *[same_share(s, f"fold {i} stratified", F.col("fold") == i, F.col("label") == 1, limit) for i in range(folds)]]


def store(tables: dict[str, tuple[DataFrame, Sequence[Constraint], str]], path: str) -> None:
    """Store the states of ``{name: (rows, constraints, partition key)}`` below ``path``."""
    for name, (df, checks, key) in tables.items():
        K.write_state(df, checks, key, f"{path}/{name}")


def report(spark: SparkSession, constraints: dict[str, Sequence[Constraint]], path: str) -> DataFrame:
    """``section, check, passed, observed`` of all tables, read from their stored states."""
    return reduce(DataFrame.unionByName, [K.verdicts(K.merged(K.read_state(spark, f"{path}/{n}")), c) for n, c in constraints.items()])
