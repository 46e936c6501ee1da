"""Stand-in entity × year panel on the driver's test tables.

Fixture F1: one row per (customer, order year) with eight 0–10 indicators,
plus the derived attributes of F2/F3 (tier, segment, gender-like key,
turning-point flag, lag, institution, tenure, phase).

Plan shape (designed for lineitem at 100 TB):

1. ``lineitem ⋈ part`` on the part key, projected to the seven columns used.
   No broadcast hint: Catalyst broadcasts ``part`` only when its statistics
   are under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a
   sort-merge join whose hot keys AQE splits (skew join).
2. Pre-aggregate per order *before* touching ``orders``: lines of an order are
   adjacent in the files, so the partial aggregate collapses them map-side;
   afterwards each order is one row, so the order join is skew-free.
3. Join ``orders`` (one row per order, year extracted in the scan stage).
4. ``groupBy(entity, year)`` with map-side partial aggregation — a customer
   holding a third of all orders still contributes at most one partial row per
   year per map task.

Arithmetic is exact: inputs are scaled to longs (4 decimals) and summed as
longs, and each indicator is the half-up rounded ratio in units of 1e-4
computed with integer division, so results depend neither on partitioning
nor on the engine (the SQL oracle takes decimal sums and gets the same
integers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.functions.bands import tier_of, tier_ordinal
from panelkit.sources.readers import read_table

__all__ = ["INDICATORS", "STANDIN_TIER_CUTS", "build_panel", "enrich_panel", "panel",
           "panel_x", "panel_table", "MISSING_IPP_YEAR"]

INDICATORS = ["ieg", "ida", "iaa", "ips", "ipv", "ian", "ipp", "inde"]
INDEX_PARTS = ["ieg", "ida", "iaa", "ips", "ipv", "ian"]
# Stand-in cut points for this panel's index (domain cut points live in config).
STANDIN_TIER_CUTS = [(4.2, "Quartzo"), (5.0, "Ágata"), (5.8, "Ametista")]
MISSING_IPP_YEAR = 2001
_SCALE = 10_000.0
_SCALE_L = 10_000


def _scaled_sum(c: str):
    return F.sum(F.round(F.col(c) * F.lit(_SCALE)).cast("long"))


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 panel: entity_id, yr, n, n_orders and the eight indicators."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    per_order = (li.join(part, li.l_partkey == part.p_partkey)
                 .groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("n"),
                      _scaled_sum("l_quantity").alias("q4"),
                      _scaled_sum("l_discount").alias("d4"),
                      _scaled_sum("l_tax").alias("t4"),
                      F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
                      F.count_if(F.col("l_linestatus") == "F").alias("n_f"),
                      F.sum("p_size").alias("s_size")))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("yr"))
    agg = (orders.join(per_order, orders.o_orderkey == per_order.l_orderkey)
           .groupBy("entity_id", "yr")
           .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_orders"),
                F.sum("q4").alias("q4"), F.sum("d4").alias("d4"), F.sum("t4").alias("t4"),
                F.sum("n_r").alias("n_r"), F.sum("n_f").alias("n_f"),
                F.sum("s_size").alias("s_size")))
    ind = agg.select(
        "entity_id", "yr", "n", "n_orders",
        (F.least(F.lit(10), F.lit(2) * F.col("n_orders")) * F.lit(_SCALE_L)).alias("ieg4"),
        _half_up("q4", 1, 5).alias("ida4"),            # mean quantity / 5
        _half_up("d4", 100, 1).alias("iaa4"),          # mean discount · 100
        _half_up("t4", 125, 1).alias("ips4"),          # mean tax · 125
        _half_up("n_r", 100_000, 1).alias("ipv4"),     # share of R · 10
        _half_up("n_f", 100_000, 1).alias("ian4"),     # share of F · 10
        F.when(F.col("yr") != F.lit(MISSING_IPP_YEAR), _half_up("s_size", 2_000, 1)).alias("ipp4"))
    ind = ind.withColumn("inde4", F.expr("(2 * ({}) + 6) div 12".format(
        " + ".join(f"{c}4" for c in INDEX_PARTS))))
    return ind.select("entity_id", "yr", "n", "n_orders",
                      *[(F.col(f"{c}4").cast("double") / F.lit(_SCALE)).alias(c) for c in INDICATORS])


def _half_up(num: str, mult: int, div: int):
    """round_half_up(num · mult / (div · n)) in exact long arithmetic — the
    indicator in units of 1e-4 (all inputs are non-negative)."""
    return F.expr(f"(2 * {mult} * {num} + {div} * n) div (2 * {div} * n)")


def enrich_panel(spark: SparkSession, sf_dir: str, p: DataFrame) -> DataFrame:
    """F2 + F3 attributes. ``customer`` is joined on the entity key (a
    shuffle join at scale; broadcast only if Catalyst's size check allows);
    ``nation`` has a fixed 25 rows and is always broadcast. Tenure is a window
    on the same entity key, so it reuses the join's partitioning."""
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("institution")))
    w = Window.partitionBy("entity_id")
    e = p.join(cust, "entity_id", "left").join(nation, "c_nationkey", "left").drop("c_nationkey")
    return e.select(
        *p.columns, "segment", "institution",
        tier_of("inde", cuts=STANDIN_TIER_CUTS).alias("tier"),
        F.when(F.col("entity_id") % 2 == 0, F.lit("Menina")).otherwise(F.lit("Menino")).alias("gender"),
        F.when(F.col("ipv") == 0, F.lit(None).cast("string"))
         .when(F.col("ipv") >= 5, F.lit("Sim")).otherwise(F.lit("Não")).alias("pv"),
        (F.col("entity_id") % 7 - 3).alias("lag"),
        (F.col("yr") - F.min("yr").over(w)).alias("tenure"),
        F.nullif(F.col("ipv"), F.lit(0.0)).alias("ipv_n"),
        (F.col("entity_id") % 8).cast("int").alias("phase"),
        F.concat((F.col("entity_id") % 8).cast("string"), F.lit("H")).alias("phase_code"),
    ).withColumn("tier_ord", tier_ordinal("tier"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(spark, sf_dir)


def panel_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched panel as a lazy plan (joins run every time it is used)."""
    return enrich_panel(spark, sf_dir, build_panel(spark, sf_dir))


def panel_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The enriched panel written once per application to the shared
    checkpoint folder, bucketed by entity, and read back for every report:
    per-entity windows (YoY, transitions, tier change, latest row) and
    entity joins run without a shuffle of the panel."""
    import hashlib
    from panelkit.session import materialize
    name = "panel_x_" + hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:12]
    return materialize(spark, name, lambda: panel_x(spark, sf_dir), bucket_by="entity_id", refresh=refresh)


def year_bounds(p: DataFrame, year: str = "yr") -> tuple[int, int]:
    """First and last year present (two numbers)."""
    r = p.agg(F.min(year), F.max(year)).first()
    return r[0], r[1]


def panel_years(p: DataFrame, year: str = "yr") -> list[int]:
    """The years present, in order (one number per year)."""
    return sorted(r[0] for r in p.select(year).distinct().collect())
