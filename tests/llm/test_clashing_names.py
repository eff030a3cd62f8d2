"""Columns of the input whose names an operator uses inside, nulls, repeats and empty tables, for operators and pipeline stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsieve.llm import best_fit, histogram_sort, host_rules, minhash_tensor, secret_scan

WORDS = " ".join(f"w{i}" for i in range(40))
ROWS = [(1, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (3, WORDS + " end", None, None, None), (4, None, "en", "a", 0), (5, "", "en", "b", 0),
        (None, "password = abcdefgh12345 " + WORDS[::-1], "de", "a", 7), (None, None, None, None, None)]
NAMES = ["_bad", "_id", "_md5", "_n", "_digest", "_size", "_copy", "_k1", "_k2", "n", "b", "l", "r", "o", "_block", "rank", "row", "group", "cls", "node", "key", "_row", "comp",
         "component_id", "kept", "_part", "_inside", "_from", "_b", "_rows", "spans"]


def table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in NAMES])


def untouched(out):
    for r in out.select("doc_id", *NAMES).collect():
        assert all(r[c] == f"{c} {'?' if r['doc_id'] is None else r['doc_id']}" for c in NAMES)


def test_operators_leave_columns_alone(spark):
    df = table(spark)
    kept = host_rules.keep_documents(df, "text", "source")
    assert kept.columns == df.columns and kept.count() == 5
    untouched(kept)
    one = minhash_tensor.one_of_each(df, "doc_id", "text")
    assert one.columns == df.columns
    untouched(one)
    assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "4", "5", "None", "None"]
    untouched(secret_scan.mask_secrets(df, "text", length_col="n_chars"))
    shards = histogram_sort.histogram_shards(df, "doc_id", "text", 3)
    assert shards.count() == len(ROWS)
    untouched(shards)
    packed = best_fit.pack(df.withColumn("length", F.coalesce("doc_id", F.lit(7))), ["doc_id"], 10)
    assert packed.count() == len(ROWS) and packed.agg(F.sum("length")).first()[0] == 31
    untouched(packed)


@pytest.mark.parametrize("names", [[], NAMES])
def test_pipeline_stages_meet_odd_tables(spark, tmp_path, names):
    docs = table(spark).select("doc_id", "text", "lang", "source", "n_chars", *names)
    for k, rows in enumerate((docs, docs.limit(0))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, "")
            if i < 3:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}-{i}")
            rows = spark.read.parquet(f"{tmp_path}/{k}-{i}")
        if k == 0:
            got = rows.select("doc_id", "length").collect()
            assert sorted(str(r["doc_id"]) for r in got) == ["1", "None"]
        else:
            assert rows.count() == 0
