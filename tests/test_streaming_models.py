"""Streaming counters equal their batch form; small MLlib smoke checks."""
import shutil
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _events_dir():
    d = tempfile.mkdtemp(prefix="panelkit-events-")
    shutil.copy(f"{SF_SMALL}/events.parquet", f"{d}/part-0.parquet")
    return d


def test_answer_points_stream_equals_batch(spark):
    from panelkit.streaming import answer_points, answer_points_stream
    d = _events_dir()
    q = answer_points_stream(spark, d, name="ap_test", sink="memory")
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT user_id, answers, right, points FROM ap_test").collect()}
    want = {tuple(r) for r in answer_points(spark.read.parquet(d)).select("user_id", "answers", "right", "points").collect()}
    assert got == want and len(got) > 0


def test_daily_activity_stream(spark):
    from panelkit.streaming import daily_activity_stream
    d = _events_dir()
    q = daily_activity_stream(spark, d, name="da_test", sink="memory")
    q.awaitTermination(120)
    n = spark.sql("SELECT count(*) AS n FROM da_test").first()["n"]
    batch = (spark.read.parquet(d).filter("event_type = 'purchase'")
             .select("user_id", F.to_date("ts").alias("d")).distinct().count())
    assert 0 < n <= batch


def test_binary_model_smoke(spark):
    """E9 + ML12 + ML16 on a planted signal, few trees for speed."""
    from panelkit.plans import models as M
    df = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"),
                                 (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("label", (F.col("x") >= 5).cast("int"))
    spec = {"kind": "rf", "numTrees": 10, "maxDepth": 3, "minInstancesPerNode": 1}
    m = M.fit(M.class_weights(df), ["x", "z"], spec)
    s = M.score_binary(m, df, 0.5)
    acc = s.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.95
    assert M.smoke_inference(m, spark, ["x", "z"]).first()["valid"]
    imp = M.feature_importance(m, ["x", "z"]).collect()
    assert imp[0]["feature"] == "x"


def test_class_weights_balanced(spark):
    from panelkit.plans.models import class_weights
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 1, "label int")
    w = {r["label"]: r["weight"] for r in class_weights(df).collect()}
    assert abs(w[1] - 4 / 6) < 1e-12 and abs(w[0] - 2.0) < 1e-12


def test_watermark_drops_late_day(spark):
    """A purchase older than the watermark arriving in a later batch is not
    counted; one inside the watermark is."""
    import os
    from panelkit.streaming import EVENT_SCHEMA, daily_activity
    d = tempfile.mkdtemp(prefix="panelkit-late-")
    import datetime as dt
    t = lambda day: dt.datetime(2024, 1, day, 12)
    src = os.path.join(d, "in")
    os.makedirs(src)
    q = None
    try:
        stream = daily_activity(spark.readStream.schema(EVENT_SCHEMA).parquet(src), watermark="1 day")
        q = (stream.writeStream.outputMode("append").format("memory").queryName("late_test")
             .option("checkpointLocation", os.path.join(d, "ck")).start())
        spark.createDataFrame([(1, t(1), 7, "purchase", 1.0, "{}"), (2, t(10), 7, "purchase", 1.0, "{}")],
                              EVENT_SCHEMA).write.mode("append").parquet(src)
        q.processAllAvailable()
        spark.createDataFrame([(3, t(2), 7, "purchase", 1.0, "{}"), (4, t(9), 7, "purchase", 1.0, "{}"),
                               (5, t(20), 7, "purchase", 1.0, "{}")], EVENT_SCHEMA).write.mode("append").parquet(src)
        q.processAllAvailable()
        spark.createDataFrame([(6, t(25), 7, "purchase", 1.0, "{}")], EVENT_SCHEMA).write.mode("append").parquet(src)
        q.processAllAvailable()
        days = {r["day"].day for r in spark.sql("SELECT day FROM late_test").collect()}
    finally:
        if q is not None:
            q.stop()
    assert 2 not in days          # day 2 arrived after the watermark passed it
    assert {1, 10} <= days        # on-time windows were emitted once closed
