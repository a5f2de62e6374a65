"""The corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs; all but the last return the columns of documents, further ones too, whatever their names.

Null and empty texts go in the first stage, as no language can be told. A null doc_id passes the filters
(it is the smallest among equal texts and links with nothing) and is packed as null. Rows that repeat a text
are one document after the second stage; ties are settled there. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silvaflow.llm import exact_dedup, langid, ngram_join, packing, secret_scan
from silvaflow.llm.common import table, tokenizer_path, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts and those without a letter; a null lang becomes the prediction."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, a null one only if it is alone; of equal doc_ids one row, always the same."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles the smallest doc_id stays; rows with a null doc_id and texts without words all stay."""
    return ngram_join.one_of_each(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; every document stays, and n_chars follows its text."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed training sequences; an empty text is its end mark alone."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secrets", remove_secrets),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
