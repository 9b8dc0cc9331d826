"""A corpus pipeline of five stages: quality rules, near duplicates, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's result as Parquet and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import mixing, near_dup, packing, pii, quality_rules
from rasterloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the learned decision list reject."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies: at least 80 % of the shingles of both are shared."""
    return near_dup.drop_near_duplicates(docs, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every found span of personal data by its kind in brackets."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated probabilities, at least four fifths of the tokens: targets of values too rare for that are approached. Kinds in brackets count as the topic of what they stand for."""
    return mixing.sample_documents(docs, least=0.8, topics=mixing.REDACTED_TOPICS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises documents and packs them into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, most=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("pack", pack)]

#: Learned rules, the similarity join and least squares have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
