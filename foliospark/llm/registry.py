"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import lines, mixing, near_duplicates, packing, quality, secrets, substrings, topk, toxicity
from .common import read
from .oracles import ORACLES


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark, sf_dir):
    return secrets.secret_findings(read(spark, sf_dir, "documents"))


def op2_exact_top_k(spark, sf_dir):
    return topk.embedding_top_k(read(spark, sf_dir, "embeddings"))


def op3_minhash_near_dedup(spark, sf_dir):
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark, sf_dir):
    return lines.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_mixing_sources(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark, sf_dir):
    return substrings.remove_repeated_bytes(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substrings.remove_repeated_words(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def quality_base(spark, sf_dir):
    """The counts of operator 5, which SQL can state, without its verdict."""
    found = lines.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark, sf_dir):
    """Operator 6's target of each source."""
    docs = read(spark, sf_dir, "documents")
    sized = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"), F.count("*").alias("n"))
    goal = mixing.targets(sized.select(mixing.source_key(F.col("source")).alias("skey"), "source_size", "n"))
    back = sized.select("source", mixing.source_key(F.col("source")).alias("skey"))
    return back.join(goal, "skey").select("source", "source_size", F.round("target", 3).alias("target"))


def queries():
    found = (
        op1_secret_scan, op2_exact_top_k, op3_minhash_near_dedup, op4_best_fit_packing, op5_quality_rules,
        op6_mixing_sources, op7_toxicity, op8_suffix_array_dedup, op9_substring_dedup, op10_quality_classifier
    )
    return {f.__name__: f for f in (*found, quality_base, mixing_targets)} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return dict(ORACLES)
