"""Streaming forms of the per-user counters.

The source application keeps quiz points and activity in UI session state.
Here the same aggregations run on an answer-event stream:

* :func:`answer_points_stream` — running points per user (+10 right, +2
  wrong) in ``update`` mode: a keyed ``groupBy().agg`` whose state holds one
  row per user.
* :func:`daily_activity_stream` — active days per user with a 1-day
  tumbling window and a watermark, so state for old days is dropped and late
  events inside the watermark still count; its output feeds the streak
  operator (W13) in batch.

Checkpoints go under the shared ``spark.checkpoint.dir`` so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit import config as C
from panelkit.session import ensure_checkpoint_dir

__all__ = ["EVENT_SCHEMA", "read_event_stream", "answer_points", "answer_points_stream", "daily_activity",
           "daily_activity_stream"]

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_event_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def answer_points(events: DataFrame, right_type: str = "purchase", wrong_type: str = "error") -> DataFrame:
    """Keyed running totals; works on a batch or a streaming frame."""
    a = events.filter(F.col("event_type").isin(right_type, wrong_type))
    ok = F.col("event_type") == right_type
    return a.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("answers"), F.sum(ok.cast("long")).alias("right"),
        F.sum(F.when(ok, F.lit(C.QUIZ_RIGHT)).otherwise(F.lit(C.QUIZ_WRONG))).cast("long").alias("points"))


def daily_activity(events: DataFrame, event_type: str = "purchase", watermark: str = "2 days") -> DataFrame:
    """Events per user per day (tumbling window, watermarked)."""
    e = events.filter(F.col("event_type") == event_type).withWatermark("ts", watermark)
    return e.groupBy("user_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.to_date(F.col("window.start")).alias("day"), "events")


def _start(df: DataFrame, name: str, mode: str, sink: str, trigger_once: bool):
    """Parquet by default: appended rows go to files of the shared folder, and
    in update mode each batch's changed rows to a folder of that batch. The
    ``memory`` sink keeps all rows on the driver and is for tests."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/") + f"/streams/{name}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", base)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    elif sink == "parquet" and mode == "update":
        w = w.foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{base}-out/batch={i}"))
    else:
        w = w.format(sink).option("path", f"{base}-out")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def answer_points_stream(spark: SparkSession, path: str, name: str = "answer_points", sink: str = "parquet",
                         trigger_once: bool = True):
    return _start(answer_points(read_event_stream(spark, path)), name, "update" if sink != "memory" else "complete",
                  sink, trigger_once)


def daily_activity_stream(spark: SparkSession, path: str, name: str = "daily_activity", sink: str = "parquet",
                          trigger_once: bool = True):
    return _start(daily_activity(read_event_stream(spark, path)), name, "append", sink, trigger_once)
