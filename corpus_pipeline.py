"""Corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsieve.llm import best_fit, host_rules, minhash_tensor, secret_scan
from tabsieve.llm.queries import tokenizer_path
from tabsieve.session import materialise

CAPACITY = 2048
#: Characters a task tokenises at once: after other stages a worker has less memory left than in a query of its own.
SLICE_CHARS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source is not rejected."""
    return host_rules.keep_documents(docs, "text", "source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 and more."""
    return minhash_tensor.one_of_each(docs, "doc_id", "text", width=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets masked; ``n_chars`` follows the text where it is known."""
    return secret_scan.mask_secrets(docs, "text", length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of ``CAPACITY`` tokens."""
    return best_fit.pack_documents(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), CAPACITY, slice_chars=SLICE_CHARS)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans), ("packing", packing)]

#: Tokens, and with them the packing, have no SQL form; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
