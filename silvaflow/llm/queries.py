"""The queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, langid, ngram_join, pii, secret_scan, topk, toxicity, trie_bpe
from .common import table, tokenizer_path, written
from .packing import pack_documents
from .token_files import read_token_files, write_token_files


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digests(table(spark, sf_dir, "documents"))


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the text at SILVAFLOW_PII_KEY_FILE, a path that Spark reads; without it these invented data get an example key."""
    path = os.environ.get("SILVAFLOW_PII_KEY_FILE")
    key = spark.read.text(path, wholetext=True) if path else written(spark.createDataFrame([("an example key",)], "key string"), "example-key")
    return pii.pseudonyms(table(spark, sf_dir, "documents"), key)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_crf_toxicity": op2_crf_toxicity,
        "op3_token_files": op3_token_files,
        "op4_exact_topk": op4_exact_topk,
        "op5_hierarchical_packing": op5_hierarchical_packing,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_trie_bpe": op7_trie_bpe,
        "op8_ppm_language": op8_ppm_language,
        "op9_feistel_pii": op9_feistel_pii,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op4_exact_topk": topk.ORACLE_SQL}
