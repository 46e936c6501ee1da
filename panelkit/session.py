"""Session factory and shared-storage helpers.

On a cluster the session is created by the launcher; ``get_session`` only
fills in settings that are *unset*, so cluster configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "panelkit", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (None when unset)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    d = spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (local
    tests) create a private scratch folder."""
    d = checkpoint_dir(spark)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="panelkit-ckpt-", dir=os.environ.get("PANELKIT_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike ``localCheckpoint``/cache) and truncates the
    plan so iterative jobs do not re-run the whole lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED = threading.local()


def store(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet into the shared checkpoint folder, and a reader over it:
    cuts the lineage like :func:`cut_lineage`, on a fraction of the disk, and can be dropped."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    for made in getattr(_STORED, "records", []):
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded_stores():
    """Collects the folders that :func:`store` makes in this thread inside the block."""
    made: list[str] = []
    _STORED.records = [*getattr(_STORED, "records", []), made]
    try:
        yield made
    finally:
        _STORED.records = [r for r in _STORED.records if r is not made]


def drop_stores(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that no plan reads any more, and let Spark's cleaner delete the shuffle files of
    plans that are gone now instead of when the driver's heap is full."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._jvm.System.gc()


_MATERIALIZED: dict = {}
_LOCK = threading.Lock()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove a working folder when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(spark: SparkSession, name: str, build, partition_by: str | None = None,
                refresh: bool = False, bucket_by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``build()`` once per application as Parquet under the shared
    checkpoint folder and return a reader over it.

    This is the lineage cut for a table that many reports reuse (the panel):
    later plans start from a pruned, pushed-down Parquet scan instead of
    re-running the joins, and a lost executor never forces a recompute.

    ``bucket_by`` stores the table hash-bucketed on that key (an external
    catalog table whose files live in the shared folder): windows, groupings
    and joins on the key then reuse the stored partitioning instead of
    shuffling. Rows are first repartitioned on the key so each bucket is one
    file. ``partition_by`` instead lets filters on a column prune files."""
    key = (spark.sparkContext.applicationId, name)
    with _LOCK:  # concurrent first readers wait for one write
        if key not in _MATERIALIZED or refresh:
            _MATERIALIZED[key] = _write(spark, name, build(), partition_by, bucket_by, buckets)
    hit = _MATERIALIZED[key]
    kind, loc, cols = hit
    src = spark.table(loc) if kind == "table" else spark.read.parquet(loc)
    return src.select(*cols)


def _write(spark: SparkSession, name: str, df: DataFrame, partition_by, bucket_by, buckets) -> tuple:
    app = spark.sparkContext.applicationId
    # per-application folder: concurrent applications never overwrite each other
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{app}/{name}"
    delete_at_end(spark, path)
    if bucket_by:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = "pk_" + "".join(ch if ch.isalnum() else "_" for ch in f"{app}_{name}")
        (df.repartition(n, bucket_by).write.mode("overwrite").format("parquet").option("path", path)
         .bucketBy(n, bucket_by).sortBy(bucket_by).saveAsTable(table))
        # table size from file metadata (no scan) for Catalyst's broadcast size checks
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS NOSCAN")
        return "table", table, df.columns
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return "path", path, df.columns
