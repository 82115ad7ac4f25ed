"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismrank.llm import codebooks, exactdedup, kmeans, langid, mixing, packing, repeats, secretscan, setjoin, simhash, topk, urlfilter, warc
from prismrank.llm._shared import table


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.documents_digest(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.documents_digest(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.pages_digest(table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.documents_digest(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.documents_digest(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.documents_digest(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embeddings_digest(table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.documents_digest(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.documents_digest(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_digest(table(spark, sf_dir, "pages"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.documents_digest(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.embeddings_digest(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.embeddings_digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_nnls_packing, op2_language_id, op3_url_filter, op4_simhash_near_dedup, op5_source_mixing, op6_secret_scan, op7_exact_top_k, op8_exact_dedup, op9_repeated_passages, op10_warc, op11_ngram_jaccard_join, op12_centroid_clustering, op13_vector_codes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": mixing.SQL, "op6_secret_scan": secretscan.SQL, "op7_exact_top_k": topk.SQL, "op8_exact_dedup": exactdedup.SQL, "op9_repeated_passages": repeats.SQL, "op10_warc": warc.SQL, "op11_ngram_jaccard_join": setjoin.SQL, "op12_centroid_clustering": kmeans.SQL, "op13_vector_codes": codebooks.SQL}
