"""Readers and writers.

* S1 delimited wide panel (``;``, latin-1) with every column read as text,
  then typed by :mod:`panelkit.operators.clean` — no schema inference pass.
* S2 snapshot table: Spark has no Excel source, so the snapshot is read as
  CSV or Parquet with an explicit schema.
* S3 Parquet tables (column pruning and filter pushdown happen in the scan).
* S5 metrics rows as JSON, S7 source row counts, S8 question bank.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["read_table", "read_delimited_panel", "read_delimited_checked", "read_snapshot", "write_metrics",
           "read_metrics", "source_counts", "non_null_counts", "QUESTION_SCHEMA",
           "read_question_bank", "question_rows", "TABLES"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S3: one Parquet table of the test set."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_delimited_panel(spark: SparkSession, path: str, columns: Iterable[str] | None = None,
                         sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The wide panel file. All columns are strings on read (D10/D11):
    typing and token repair happen as column expressions afterwards.

    With ``columns`` given the schema is explicit and no inference job runs."""
    r = (spark.read.option("header", "true").option("sep", sep)
         .option("encoding", encoding).option("mode", "PERMISSIVE"))
    if columns is not None:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        r = r.option("inferSchema", "false")
    return r.csv(path)


#: the line as it was read, for lines that do not fit the columns
BAD_LINE = "__line"


def read_delimited_checked(spark: SparkSession, path: str, columns: Iterable[str], sep: str = ";",
                           encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """S1 with a quarantine: ``(accepted, quarantined)``. A line with fewer or more
    fields than ``columns`` is neither padded nor cut but kept whole, with its file,
    number of fields and reason. Quoted separators are no field ends. Every line
    that is not blank and no file's header is in exactly one of the two tables.
    Both are lazy reads of the files; column pruning is off for them, as a parser
    that skips columns does not see a line's length."""
    from pyspark.sql import functions as F
    columns = list(columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD_LINE]])
    raw = (spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE")
           .option("columnPruning", "false").option("columnNameOfCorruptRecord", BAD_LINE).schema(schema).csv(path))
    # Spark refuses plans that read the line column alone: this always true condition reads a column beside it
    raw = raw.where(F.hash(columns[0]) >= F.lit(-2 ** 31))
    accepted = raw.where(F.col(BAD_LINE).isNull()).select(*columns)
    bare = F.regexp_replace(BAD_LINE, '"([^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    bad = raw.where(F.col(BAD_LINE).isNotNull()).select(
        F.col("_metadata.file_name").alias("file"), F.col(BAD_LINE).alias("line"), fields.cast("int").alias("fields"))
    reason = (F.when(F.col("fields") < len(columns), "too few fields").when(F.col("fields") > len(columns), "too many fields")
              .otherwise("unreadable"))
    return accepted, bad.withColumn("reason", reason)


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: T.StructType | None = None, **options) -> DataFrame:
    """Snapshot table exported as CSV/Parquet (re-aimed from Excel)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON (one small file; metrics are a few rows)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def source_counts(named: dict[str, DataFrame]) -> DataFrame:
    """(source, rows) for each named source, as one small union."""
    parts = [df.select(F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows"))
             for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def non_null_counts(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Non-null count per column from one aggregation pass, as rows."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "non_null")


QUESTION_SCHEMA = T.StructType([
    T.StructField("subject", T.StringType(), False),
    T.StructField("question_id", T.IntegerType(), False),
    T.StructField("question", T.StringType(), False),
    T.StructField("options", T.ArrayType(T.StringType()), False),
    T.StructField("answer", T.StringType(), False),
    T.StructField("hint", T.StringType(), True),
])


def read_question_bank(spark: SparkSession, path: str) -> DataFrame:
    """Question bank (JSON lines) as a dimension table."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)


def question_rows(spark: SparkSession, bank: dict) -> DataFrame:
    """Build the dimension from a ``{subject: [{question, options, answer,
    hint}, ...]}`` mapping; ``question_id`` is the position within the subject."""
    rows = [(subj, i, q["question"], list(q["options"]), q["answer"], q.get("hint"))
            for subj, items in bank.items() for i, q in enumerate(items)]
    return spark.createDataFrame(rows, QUESTION_SCHEMA)
