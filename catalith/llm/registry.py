"""Queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, hard_negatives, html_extract, license_scan, partenum_join, pii_crf, quality_mcd, secret_scan, sentencepiece_bpe, substring_dedup, template_decontam, token_store, warc
from .textkit import shared_dir


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; the files are a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, vocabulary("word_bpe_49k.json"), shared_dir(spark, "tokens"), end_id=2)
    return token_store.read_store(spark, store, token_store.document_keys(docs))


def op4_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.assess(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.link_documents(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.scan(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_warc": op2_warc,
    "op3_token_store": op3_token_store,
    "op4_quality_mcd": op4_quality_mcd,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_template_decontam": op6_template_decontam,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_partenum_join": op8_partenum_join,
    "op9_secret_scan": op9_secret_scan,
    "op10_pii_crf": op10_pii_crf,
    "op11_centroids": op11_centroids,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op6_template_decontam": template_decontam.SQL,
    "op8_partenum_join": partenum_join.SQL,
    "op11_centroids": centroids.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_license_scan": license_scan.SQL,
}
