"""The queries of this subpackage: thin wrappers that apply one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, certified_packing, hard_negatives, lexical_search, media, near_dedup, packing, quality_rules, suffix_arrays, suffix_trees, templates, toxicity, training_order
from .common import read_table

#: Where vocabulary files of public tokenizers are found; a parameter of the operators.
try:
    from public_tokenizers import path as vocabulary
except ImportError:
    vocabulary = "/opt/tokenizers/{}".format


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed")


def op1_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extracted(read_table(spark, sf_dir, "pages"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.coded(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.digests(read_table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = training_order.written(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    rows = training_order.sequences(manifest)
    return rows.select("slot", "sequence", "shard", "offset", "n_tokens", "doc_ids", "ids_crc32", F.sha2("ids", 256).alias("ids_sha256"))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.stored(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.digests(read_table(spark, sf_dir, "documents"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"), n=4, percent=80)


def op11_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certified_packing.packed(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_text": op1_template_text,
    "op2_bpe_automaton": op2_bpe_automaton,
    "op3_suffix_tree_dedup": op3_suffix_tree_dedup,
    "op4_training_order": op4_training_order,
    "op5_kneser_ney_toxicity": op5_kneser_ney_toxicity,
    "op6_media_columns": op6_media_columns,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_vector_packing": op8_vector_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_certified_packing": op11_certified_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}
