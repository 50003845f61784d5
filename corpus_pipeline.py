"""Corpus pipeline: five stages over ``documents``, each by one of the text operators.

Every stage is ``function(spark, docs, sf_dir) -> DataFrame``.  Its result is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.  Filters act on rows, not on ids: where doc_ids repeat or are
missing, each row has its own verdict.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalith.llm import partenum_join, pii_crf, quality_mcd, registry, sentencepiece_bpe, template_decontam
from catalith.llm.textkit import shared_dir

#: SQL cannot express the stages' models; tests hold each stage against plain Python.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go."""
    return quality_mcd.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that with the smallest doc_id."""
    return partenum_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return template_decontam.decontaminate(docs, registry.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; n_chars follows the text."""
    return pii_crf.redact_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text per document."""
    return sentencepiece_bpe.encode_decode(docs, registry.vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("SentencePiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = registry.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_dir(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
