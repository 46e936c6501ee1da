"""A corpus pipeline of five stages, each calling one training-data operator on
all that the stage before it kept. Every stage's result is written as Parquet to
the shared folder and read again as the next stage's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bpe, curriculum, exact_dedup, quality, simhash
from panelkit.llm.common import documents, drop_paths, recorded_paths, shared_path
from panelkit.llm.queries import tokenizer_path


#: working tables of the stage that ran last
_working: list[str] = []


def _stage(f: Callable) -> Callable:
    """A stage's working tables are dropped when the next stage begins, as its
    result is written by then (and kept if the new documents still read them)."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        drop_paths(spark, [p for p in _working if not any(p in x for x in files)])
        with recorded_paths() as made:
            out = f(spark, docs, sf_dir)
        _working[:] = made
        return out
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels, carry=True).where("kept").select("row.*")


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.near_dedup(docs, carry=True).where("kept").select("row.*")


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row for each whole copy taken, in training order."""
    return curriculum.curriculum_mix(docs, whole=True, carry=True).select("row.*")


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; decoding them gives the text back."""
    out = bpe.bpe(docs, tokenizer_path(), carry=True)
    made = {"n_tokens": F.col("n_tokens"), "ids": F.col("ids"), "decoded_sha256": F.sha2(F.col("decoded"), 256)}
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c not in made]
    return out.select(*keep, *[c.alias(n) for n, c in made.items()])


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mixing),
    ("BPE encoding and decoding", tokens),
]

#: learned rules, XXH64 majorities and BPE merges have no SQL form; the tests use a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
