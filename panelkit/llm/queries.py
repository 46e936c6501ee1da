"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from panelkit.llm import (bpe, chaining, curriculum, exact_dedup, langid, license, negatives, phrases, quality, shuffle, simhash, suffix,
                          toxicity)
from panelkit.llm.common import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix.suffix_dedup(documents(spark, sf_dir)).drop("spans")


def op2_mixing(spark, sf_dir):
    return curriculum.mix_report(documents(spark, sf_dir))


def op3_sharding(spark, sf_dir):
    return shuffle.shard_report(documents(spark, sf_dir))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_simhash(spark, sf_dir):
    return simhash.near_dedup(documents(spark, sf_dir))


def op7_license_scan(spark, sf_dir):
    return license.license_scan(documents(spark, sf_dir), license.document_path())


def op8_bpe(spark, sf_dir):
    return bpe.bpe(documents(spark, sf_dir), tokenizer_path(), digests=True)


def op9_toxicity(spark, sf_dir):
    out = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "toxic", *[f"p_{n}" for n, _ in toxicity.CHAIN])


def op10_passages(spark, sf_dir):
    return chaining.passage_dedup(documents(spark, sf_dir)).drop("passages")


def op11_language(spark, sf_dir):
    return langid.held_out_report(documents(spark, sf_dir))


def op12_hard_negatives(spark, sf_dir):
    return negatives.mine_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_phrases(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_mixing, op3_sharding, op4_exact_dedup, op5_quality_rules, op6_simhash, op7_license_scan, op8_bpe, op9_toxicity,
    op10_passages, op11_language, op12_hard_negatives, op13_phrases)}
SQL = {"op2_mixing": curriculum.SQL, "op4_exact_dedup": exact_dedup.SQL, "op7_license_scan": license.SQL,
       "op12_hard_negatives": negatives.SQL, "op13_phrases": phrases.SQL}
