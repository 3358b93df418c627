"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, tokens.

Each stage is a (name, function) pair; a function takes ``(spark, docs, sf_dir)`` and
returns what goes on.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsmith.llm import bpe, exact_dedup, langid, minhash_join, mixing
from tabsmith.llm.common import scratch, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an accepted language."""
    return langid.keep_known(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    return minhash_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe.digest(docs, bpe.read_spec(tokenizer_path(VOCABULARY)))


STAGES = [("language ID", language_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage),
          ("mixing", mixing_stage), ("BPE", token_stage)]

#: Neither the text model nor the tokens can be put in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
