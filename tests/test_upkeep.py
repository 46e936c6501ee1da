"""The latest-state table: batches equal a full rebuild, untouched buckets stay."""
import os
import random
import tempfile

from pyspark.sql import functions as F

from panelkit.operators import upkeep as K
from panelkit.operators.topk import bottom_k

SCHEMA = "id long, yr int, x double, t string"


def put(spark, path, data):
    return K.upsert(spark, path, spark.createDataFrame(data, SCHEMA), "id", "yr", ["x", "t"], 8)


def read(spark, path):
    return {r["id"]: [tuple(h) for h in r["history"]] for r in K.read_state(spark, path).collect()}


def plain(batches):
    want = {}
    low = lambda v: (v is not None, v if v is not None else 0)
    for batch in batches:
        best = {}
        for i, y, x, t in batch:
            if i is not None and y is not None and ((i, y) not in best or (low(x), low(t)) > (low(best[i, y][0]), low(best[i, y][1]))):
                best[i, y] = (x, t)
        for (i, y), v in best.items():
            want.setdefault(i, {})[y] = v
    return {i: [(y, *v) for y, v in sorted(h.items())] for i, h in want.items()}


def test_batches_equal_a_full_rebuild_and_untouched_buckets_stay(spark):
    rnd = random.Random(4)
    row = lambda i: (i, 2000 + rnd.randrange(4), rnd.choice([None, 1.0, 2.5]), rnd.choice([None, "a", "b"]))
    first = [row(rnd.randrange(60)) for _ in range(300)] + [(None, 2000, 1.0, "a"), (3, None, 1.0, "a")] + [(7, 2001, 1.0, "a")] * 100
    second = [(5, 2003, 9.0, "z"), (5, 2003, None, "z"), (1000, 2001, None, None)]  # a changed and a new entity
    path = tempfile.mkdtemp(prefix="panelkit-state-")
    assert put(spark, path, first) == list(range(8)) and read(spark, path) == plain([first])
    files = {f"{p}/{f}": os.stat(f"{p}/{f}").st_mtime_ns for p, _, fs in os.walk(f"{path}/rows") for f in fs}
    touched = put(spark, path, second)
    assert 1 <= len(touched) <= 2 and read(spark, path) == plain([first, second])
    assert all(os.stat(f).st_mtime_ns == t for f, t in files.items())
    gens = K.generations(spark, path)
    assert {b for b, g in gens.items() if g == 1} == set(touched) and len(gens) == 8
    used = {f.split("generation=")[1][:1] + f.split("bucket=")[1][:1] for f in K.read_state(spark, path).inputFiles()}
    assert used == {f"{g}{b}" for b, g in gens.items()}  # replaced buckets are not read


def test_a_failed_batch_is_not_read_and_may_be_run_again(spark):
    path = tempfile.mkdtemp(prefix="panelkit-state-")
    put(spark, path, [(1, 2000, 1.0, "a")])
    # rows of a generation that no one named: the batch failed before it ended
    spark.createDataFrame([(9, 0)], "id long, bucket int").write.partitionBy("bucket").parquet(f"{path}/rows/generation=1")
    assert read(spark, path) == {1: [(2000, 1.0, "a")]}
    put(spark, path, [(2, 2001, 2.0, "b")])
    assert read(spark, path) == {1: [(2000, 1.0, "a")], 2: [(2001, 2.0, "b")]}
    assert put(spark, path, []) == [] and len(read(spark, path)) == 2


def test_latest_and_previous(spark):
    path = tempfile.mkdtemp(prefix="panelkit-state-")
    put(spark, path, [(1, 2000, 1.0, "a"), (1, 2002, None, "b"), (2, 2001, 3.0, None)])
    got = {r["id"]: r for r in K.latest(K.read_state(spark, path), "id", "yr", ["x", "t"]).collect()}
    assert tuple(got[1])[1:] == (2002, None, "b", 2000, 1.0, "a", 2) and tuple(got[2])[1:] == (2001, 3.0, None, None, None, None, 1)


def test_bottom_k_by_key_with_a_hot_key_and_merging(spark):
    rnd = random.Random(5)
    data = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice([None, *range(20)]), i) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, v long, id long")
    order = [F.col("v").asc(), F.col("id").asc()]
    want = set()
    for key in {k for k, _, _ in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {(*r, i + 1) for i, r in enumerate(mine[:5])}
    for parts in (1, 4, 32):
        assert set(map(tuple, bottom_k(df, ["k"], order, 5, ["id"], parts).collect())) == want
    halves = [bottom_k(df.where(f"id % 2 = {i}"), ["k"], order, 5, ["id"]).drop("rank") for i in (0, 1)]
    assert set(map(tuple, bottom_k(halves[0].unionByName(halves[1]), ["k"], order, 5, ["id"]).collect())) == want
    assert bottom_k(df.limit(0), ["k"], order, 5, ["id"]).count() == 0
    plan = bottom_k(df, ["k"], order, 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # tasks cut to k before the shuffle
