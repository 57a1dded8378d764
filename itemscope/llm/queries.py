"""Registered queries of the corpus operators, with production parameters, over whole tables."""

import public_tokenizers
from pyspark.sql import functions as F

from itemscope.llm import (
    conversation_repair, decontamination, exact_dedup, extraction, language_model, packing, secret_scan, sharding, simhash,
    suffix_dedup, token_counts, toxicity,
    whitening)
from itemscope.llm.common import table


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.histogram_shards(table(spark, sf_dir, "documents"), shards=24)


def op4_html_extraction(spark, sf_dir):
    return extraction.main_texts(table(spark, sf_dir, "pages"))


def op5_katz_scores(spark, sf_dir):
    return language_model.katz_scores(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"), length=1024)


def op7_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"),
                                         table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"), owner="source")


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=16)


def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(conversations), conversations)


def op13_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=400).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ALL = {f.__name__: f for f in (
    op1_token_counts, op2_simhash_near_dedup, op3_sharding, op4_html_extraction, op5_katz_scores,
    op6_packing, op7_decontamination, op8_exact_dedup, op9_toxicity, op10_secret_scan,
    op11_embedding_whitening, op12_conversation_repair, op13_suffix_dedup)}
