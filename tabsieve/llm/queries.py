"""One query per operator over the given tables, with SQL where SQL can state it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import (best_fit, bpe_replay, chat_format, cross_entropy, histogram_sort, host_rules, minhash_tensor, periodic_runs, secret_scan,
                          spelling_variants, spot_signatures, token_counts, warc)
from tabsieve.llm.oracles import SQL  # noqa: F401


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(_table(spark, sf_dir, "pages"), "page_id", "url", F.col("html"))
    return read.select(F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_sort.histogram_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 8)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edited_likeness(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_verdicts(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("word_bpe_49k.json"), 2048)


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return cross_entropy.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id", "text", target)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_tensor.near_components(_table(spark, sf_dir, "documents"), "doc_id", "text", width=3, percent=85, half_keys=8)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("word_bpe_49k.json"), 2048)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.encode_texts(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern(),
                                   digests=True)


def looped(doc_id, words: list) -> list:
    """The words of a tenth of all documents, by the CRC-32 of the id, as a loop from some word on (null id: empty)."""
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), "doc_id", "text", looped)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), F.sha2(text, 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), (-F.col("b.m")).alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * -b.m div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    facts = chat_format.conversation_facts(chat_format.format_conversations(turns, "conv_id", "turn", "role", "text"))
    return facts.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "accepted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(spelling_variants.word_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", delete_every=199))


QUERIES = {f.__name__: f for f in (op1_warc, op2_histogram_sort, op3_spotsigs, op4_host_rules, op5_best_fit, op6_cross_entropy, op7_minhash,
                                   op8_token_counts, op9_secret_scan, op10_bpe_replay, op11_periodic_runs, op12_chat_format, op13_spelling_variants)}
