"""Scans, sinks and the resumable result matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators.compare import union_all
from tabsieve.operators.encode import category_mapping
from tabsieve.queries.registry import query, table
from tabsieve.session import shared_folder
from tabsieve.sources import stages, tables


@query("s1_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, folder):
    src = table(spark, folder, "customer")
    path = shared_folder(spark)
    src.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, src.schema)


@query("s2_blank_separated_scan", """
SELECT CAST(p_partkey AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b, p_retailprice AS c FROM part""")
def blank_separated_scan(spark, folder):
    path = shared_folder(spark)
    (table(spark, folder, "part").select(F.format_string("  %d   %d %s", "p_partkey", "p_size", F.col("p_retailprice").cast("string"))
                                         .alias("value")).write.text(path))
    return tables.read_number_lines(spark, path, ["a", "b", "c"])


@query("s3_gzip_sample_cache", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def gzip_sample(spark, folder):
    src = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    path = shared_folder(spark)
    stages.write_sample(src, path)
    return tables.read_csv(spark, path, src.schema)


@query("s4_stage_store", "SELECT p_partkey, p_type, p_size, p_retailprice FROM part")
def stage_store(spark, folder):
    store = stages.StageStore(spark, shared_folder(spark), "part")
    store.write(table(spark, folder, "part").select("p_partkey", "p_type", "p_size", "p_retailprice"), 1, csv=True, compression="gzip")
    return store.read(1)


MAPPING_SQL = """
SELECT col AS "column", CAST(dense_rank() OVER (PARTITION BY col ORDER BY category) - 1 AS INTEGER) AS code, category FROM (
  SELECT DISTINCT 'p_brand' AS col, p_brand AS category FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part
  UNION ALL SELECT DISTINCT 'p_name', p_name FROM part)"""


@query("s5_category_mapping_store", MAPPING_SQL)
def mapping_store(spark, folder):
    store = stages.StageStore(spark, shared_folder(spark), "part")
    store.write_mapping(category_mapping(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"]))
    return store.read_mapping()


@query("s6_config_json", """
SELECT '{"c_mktsegment":"' || c_mktsegment || '","n":' || count(*) || ',"nations":' || count(DISTINCT c_nationkey) || '}' AS config
FROM customer GROUP BY c_mktsegment""")
def config_sink(spark, folder):
    rows = (table(spark, folder, "customer").groupBy("c_mktsegment")
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations")))
    return stages.config_json(rows)


@query("s7_result_file_scan", """
SELECT 'events' AS dataset_name, event_type AS synthesizer, event_id, value FROM events""")
def result_file_scan(spark, folder):
    src = table(spark, folder, "events").select("event_id", "value", "event_type")
    base = shared_folder(spark)
    # one folder per event type, five types in all
    for kind in [r[0] for r in src.select("event_type").distinct().orderBy("event_type").collect()]:
        src.where(F.col("event_type") == kind).drop("event_type").write.option("header", True).csv(f"{base}/events_{kind}.csv")
    return tables.read_result_files(spark, f"{base}/*.csv", "event_id long, value double").select(
        "dataset_name", "synthesizer", "event_id", "value")


@query("s8_open_jobs", """
SELECT DISTINCT o_orderpriority AS dataset, o_orderstatus AS arm, o_custkey AS synth FROM orders a
WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice > 400000 AND a.o_orderpriority = b.o_orderpriority
                  AND a.o_orderstatus = b.o_orderstatus AND a.o_custkey = b.o_custkey)""")
def open_jobs(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("arm"),
                                              F.col("o_custkey").alias("synth"), "o_totalprice")
    jobs = o.select("dataset", "arm", "synth").distinct()
    return stages.open_jobs(jobs, o.where(F.col("o_totalprice") > 400000))


@query("s9_failure_rows", """
SELECT 'lineitem' AS dataset, f.l_returnflag AS arm, 'all' AS synth, CASE WHEN f.l_returnflag = 'N' THEN NULL ELSE f.n END AS n,
       CASE WHEN f.l_returnflag = 'N' THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN f.l_returnflag = 'N' THEN 'cannot fit' END AS error
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag) f""")
def failure_rows(spark, folder):
    lines = table(spark, folder, "lineitem")
    jobs = lines.select(F.lit("lineitem").alias("dataset"), F.col("l_returnflag").alias("arm"), F.lit("all").alias("synth")).distinct()

    def work(job):
        fitted = F.when(F.col("l_returnflag") == "N", F.raise_error(F.lit("cannot fit"))).otherwise(F.lit("1"))  # fails while the rows are read
        return lines.where(F.col("l_returnflag") == job["arm"]).agg(F.count(fitted).alias("n"))

    return union_all(stages.run_jobs(jobs, work)).select("dataset", "arm", "synth", "n", "status",
                                                         F.regexp_extract("error", "cannot fit", 0).alias("error"))
