"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import additive_ann, bit_dups, chat, chunk_dedup, mixing, near_dup, packing, pii, quality_rules, suffix_dedup, url_filter, word_runs, word_variants
from rasterloom.llm.common import table


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return additive_ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), most=2048)


def op3_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect_pii(table(spark, sf_dir, "documents")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    residuals = ((F.round(f"mix_{x}_residual", 6) + F.lit(0.0)).alias(f"{x}_residual") for x in mixing.AXES)
    return mixed.select(
        "doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("mix_probability", 5).alias("probability"), *residuals, F.col("mix_kept").alias("kept")
    )


def op7_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents"), **chunk_dedup.PASSAGES)
    return out.select("doc_id", "n_bytes", "n_removed", F.size(F.coalesce("removed", F.array())).cast("long").alias("n_chunks_removed"), "kept_sha256", "kept_text")


def op8_url_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op10_chosen_path_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_documents(table(spark, sf_dir, "documents"))


def op11_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return word_runs.digest(word_runs.find_runs(docs.withColumn("text", word_runs.repeating(F.col("text"), F.col("doc_id")))))


def op12_trie_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_variants.vocabulary(table(spark, sf_dir, "documents"), change=word_variants.thinned)
    return word_variants.group_variants(words)


def op13_popcount_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_dups.link_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_additive_ann, op2_pattern_packing, op3_suffix_merge_dedup, op4_perspective_rotation, op5_pii_spans, op6_source_mixing,
        op7_gear_chunk_dedup, op8_url_bayes, op9_quality_rules, op10_chosen_path_near_dup,
        op11_recompression_runs, op12_trie_pair_variants, op13_popcount_simhash,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_perspective_rotation": chat.ROTATE_SQL, "op6_source_mixing": mixing.mix_sql()}
