"""Student progress: badges, XP, missions, weakest subject, quiz sessions
(F14–F19, W12, J10, R18) as batch DataFrame plans over answer events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit import config as C
from panelkit.functions.core import col_
from panelkit.operators.evaluation import quantile_ranges
from panelkit.operators.rules import reasons

__all__ = ["event_ordinal", "quiz_sessions", "quiz_band", "weakest_subject", "badges", "xp_level", "progress_report",
           "missions", "BADGES", "SUBJECTS"]

# fixed values: subjects in tie-break order
SUBJECTS = ["Matemática", "Português", "Inglês"]
# fixed values: badge ids in definition order
BADGES = ["first_login", "inde_7", "inde_8", "nota_mat_8", "nota_port_8", "streak_3", "topazio"]


#: time ranges that one entity's events are numbered in
EVENT_RANGES = 256


def event_ordinal(events: DataFrame, entity: str, ts: str, tiebreak: str, ranges: int = EVENT_RANGES) -> DataFrame:
    """0-based position of each event in (ts, tiebreak) order per entity,
    without a window over all events of an entity or of one of its days: the
    events' times are cut at ``ranges`` quantiles (numbers, fetched
    once), events are numbered inside (entity, range), and offsets come from a
    window over one row per range. An entity with most of the events, also
    within one day, is spread over the ranges its events fall in. Events without
    a time come last, in tiebreak order; a missing entity is an entity of its own.
    Results do not depend on ``ranges``: raise it with the events of the largest entity."""
    e = quantile_ranges(events.withColumn("__t", F.col(ts).cast("timestamp").cast("double")), "__t", "__r", ranges)
    parts = e.groupBy(entity, "__r").agg(F.count(F.lit(1)).alias("__c"))
    wd = Window.partitionBy(entity).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__off", F.coalesce(F.sum("__c").over(wd), F.lit(0))).drop("__c")
    wi = Window.partitionBy(entity, "__r").orderBy(ts, tiebreak)
    parts = parts.withColumnsRenamed({entity: "__e", "__r": "__pr"})
    return (e.join(parts, F.col(entity).eqNullSafe(F.col("__e")) & (F.col("__r") == F.col("__pr")))
            .withColumn("ordinal", F.col("__off") + F.row_number().over(wi) - 1)
            .drop("__r", "__t", "__off", "__e", "__pr"))


def quiz_band(right: Column) -> Column:
    """Result band of a finished session: 10 / ≥8 / ≥5 / else."""
    return (F.when(right >= C.QUIZ_LENGTH, F.lit("perfect")).when(right >= 8, F.lit("elite"))
            .when(right >= 5, F.lit("good")).otherwise(F.lit("keep_trying")))


def quiz_sessions(answers: DataFrame, entity: str = "user_id", ts: str = "ts", tiebreak: str = "event_id",
                  correct: Column | str = "correct") -> DataFrame:
    """answers in blocks of 10 per entity → session points (+10 right,
    +2 wrong, +20 on finishing all 10) and result band."""
    o = event_ordinal(answers.withColumn("__ok", col_(correct).cast("boolean")), entity, ts, tiebreak)
    o = o.withColumn("session", F.floor(F.col("ordinal") / C.QUIZ_LENGTH).cast("long"))
    s = o.groupBy(entity, "session").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("__ok")).alias("right"))
    complete = F.col("answers") == C.QUIZ_LENGTH
    pts = (F.col("right") * C.QUIZ_RIGHT + (F.col("answers") - F.col("right")) * C.QUIZ_WRONG
           + F.when(complete, F.lit(C.QUIZ_FINISH)).otherwise(F.lit(0)))
    return s.select(entity, "session", "answers", "right", complete.alias("complete"), pts.cast("long").alias("points"),
                    F.when(complete, quiz_band(F.col("right"))).alias("band"))


def weakest_subject(mat="nota_mat", port="nota_port", ing="nota_ing") -> Column:
    """subject with the lowest grade, first in subject order on ties;
    missing grades are skipped."""
    arr = F.array(*[F.struct(col_(c).cast("double").alias("g"), F.lit(i).alias("o"), F.lit(s).alias("s"))
                    for i, (c, s) in enumerate(zip([mat, port, ing], SUBJECTS))])
    return F.array_min(F.filter(arr, lambda x: x["g"].isNotNull()))["s"]


def badges(inde="inde", mat="nota_mat", port="nota_port", streak="streak", tier="tier") -> Column:
    """badge ids earned (first_login always)."""
    conds = [F.lit(True), col_(inde) >= 7.0, col_(inde) >= 8.0, col_(mat) >= 8.0, col_(port) >= 8.0,
             col_(streak) >= 3, col_(tier).isin("Topázio", "Diamante")]
    return reasons(conds, BADGES)


def xp_level(inde="inde", badge_arr="badges", quiz_points: Column | None = None) -> list[Column]:
    """F16: xp = int(100·index + 50·badges) (+ quiz points, which the source
    loses on re-render); level = xp div 1000 + 1; progress = xp mod 1000."""
    xp = (col_(inde) * F.lit(float(C.XP_PER_INDE)) + F.size(badge_arr) * F.lit(float(C.XP_PER_BADGE))).cast("long")
    if quiz_points is not None:
        xp = xp + F.coalesce(quiz_points, F.lit(0)).cast("long")
    return [xp.alias("xp"), (F.floor(xp / C.XP_PER_LEVEL) + 1).cast("long").alias("level"),
            F.pmod(xp, F.lit(C.XP_PER_LEVEL)).cast("long").alias("progress")]


def missions(df: DataFrame, keep: list[str], columns: dict) -> DataFrame:
    """each entity × the fixed mission list (generated inline, no join):
    progress = min(current/target·100, 100), done flag and reward.
    ``columns`` maps the mission's measured column to the frame's column."""
    items = [F.struct(F.lit(mid).alias("mission"), col_(columns.get(c, c)).cast("double").alias("current"),
                      F.lit(float(t)).alias("target"), F.lit(xp).alias("reward_xp"))
             for mid, c, t, xp in C.MISSIONS]
    m = df.select(*keep, F.explode(F.array(*items)).alias("m")).select(*keep, "m.*")
    done = F.coalesce(F.col("current") >= F.col("target"), F.lit(False))
    pct = F.when(F.col("current").isNotNull(),
                 F.least(F.col("current") / F.col("target") * F.lit(100.0), F.lit(100.0)))
    return m.select(*keep, "mission", "current", "target", F.round(pct, 6).alias("progress_pct"),
                    done.alias("done"), F.when(done, F.col("reward_xp")).otherwise(F.lit(0)).alias("reward"))


def progress_report(history: DataFrame, latest: DataFrame, entity: str = "entity_id", year: str = "yr",
                    index: str = "inde") -> DataFrame:
    """Per entity — YoY deltas of the index (as a sorted array),
    total gain first→last, badges, XP/level and weakest subject.
    ``history`` is the long panel; ``latest`` one row per entity with the
    grade, tier and streak columns used by :func:`badges`."""
    from panelkit.operators.windows import first_last, yoy_delta
    d = yoy_delta(history.select(entity, year, index), entity, year, [index])
    yoy = d.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(year, F.col(f"d_{index}").alias("delta"))))
                                .alias("yoy"))
    gain = first_last(history, entity, year, index).select(entity, F.col("change").alias("total_gain"), "verdict")
    b = latest.withColumn("badges", badges(index, "ida", "ips", "streak", "tier"))
    b = b.select(entity, "badges", *xp_level(index, "badges"), weakest_subject("ida", "ips", "ipp").alias("weakest"))
    return b.join(gain, entity).join(yoy, entity)
