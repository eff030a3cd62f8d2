"""Aggregates, audits and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.functions.ranking import average_ranks, exact_quantiles
from tabsieve.operators import diagnose, filters, scale
from tabsieve.operators.centre import density_histogram
from tabsieve.queries.registry import longs, query, rounded, table


@query("a2_value_counts", """
SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def value_counts(spark, folder):
    return rounded(diagnose.value_counts(table(spark, folder, "events"), "event_type"), "share", digits=6)


@query("a2_majority_share", """
SELECT count(*) AS n_classes, round(max(n) / sum(n), 6) AS baseline FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""")
def majority(spark, folder):
    return rounded(diagnose.majority_share(table(spark, folder, "orders"), "o_orderstatus"), "baseline", digits=6)


LINE_COLUMNS = ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")


@query("a3_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in LINE_COLUMNS))
def distincts(spark, folder):
    return filters.distinct_count_table(table(spark, folder, "lineitem"), LINE_COLUMNS)


NULLED_DOCS = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang, source FROM documents"


@query("a4_equivalence_classes", f"SELECT lang, source, count(*) AS size FROM ({NULLED_DOCS}) GROUP BY lang, source")
def classes(spark, folder):
    d = table(spark, folder, "documents").withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.col("lang")))
    return diagnose.equivalence_classes(d, ["lang", "source"])


@query("a4_equivalence_summary", """
SELECT count(*) AS n_groups, median(size) AS median_size, round(sum(CASE WHEN size = 1 THEN size ELSE 0 END) / sum(size), 6) AS unique_share
FROM (SELECT l_quantity, l_tax, l_discount, l_linenumber, l_returnflag, count(*) AS size FROM lineitem GROUP BY ALL)""")
def class_summary(spark, folder):
    lines = table(spark, folder, "lineitem")
    qi = ["l_quantity", "l_tax", "l_discount", "l_linenumber", "l_returnflag"]
    return rounded(diagnose.equivalence_summary(lines, qi), "unique_share", digits=6)


@query("a4_quasi_identifier_classes", """
SELECT l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus, count(*) AS size FROM lineitem GROUP BY ALL""")
def qi_classes(spark, folder):
    lines = table(spark, folder, "lineitem").drop("l_shipdate")
    return diagnose.equivalence_classes(lines, diagnose.quasi_identifiers(lines, lines.columns))


KEPT_ORDERS = "o_totalprice <= 400000 AND NOT (o_orderstatus = 'P' AND o_totalprice > 300000)"


@query("a5_class_loss", f"""
WITH c AS (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE {KEPT_ORDERS}) AS kept FROM orders GROUP BY 1)
SELECT sum(kept)::BIGINT AS kept, round(1 - sum(kept) / sum(n), 6) AS overall_loss,
       round(max(1 - kept / n) - (1 - sum(kept) / sum(n)), 6) AS worst_excess,
       max(1 - kept / n) - (1 - sum(kept) / sum(n)) <= 0.1 + 1e-9 AS cap_ok FROM c""")
def loss(spark, folder):
    o = table(spark, folder, "orders")
    return rounded(diagnose.class_loss(o, o.where(KEPT_ORDERS), "o_orderstatus"), "overall_loss", "worst_excess", digits=6)


@query("a6_removal_audit", f"""
WITH c AS (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE {KEPT_ORDERS}) AS kept FROM orders GROUP BY 1),
o AS (SELECT 1 - sum(kept) / sum(n) AS rate FROM c)
SELECT o_orderstatus, n, n - kept AS removed, round((n - kept) / n, 6) AS rate, (n - kept) / n - o.rate <= 0.1 + 1e-9 AS cap_ok,
       round(o.rate, 6) AS overall_rate FROM c, o""")
def audit(spark, folder):
    o = table(spark, folder, "orders")
    return rounded(diagnose.removal_audit(o, o.where(KEPT_ORDERS), "o_orderstatus"), "rate", "overall_rate", digits=6)


@query("a7_exact_quantiles", """
SELECT l_returnflag, l_linestatus, count(*) AS n_values, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25 FROM lineitem GROUP BY 1, 2""")
def quantiles(spark, folder):
    out = exact_quantiles(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.9, 0.25], ["q90", "q25"])
    return rounded(out, "q90", "q25")


@query("a8_median", "SELECT event_type, round(median(value), 4) AS median FROM events GROUP BY 1")
def median(spark, folder):
    return rounded(exact_quantiles(table(spark, folder, "events"), ["event_type"], "value", [0.5], ["median"]).drop("n_values"), "median")


@query("a13_density_histogram", """
WITH s AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 30.0 AS width, count(*) AS total FROM events GROUP BY 1)
SELECT e.event_type, CAST(least(greatest(floor((value - lo) / width), 0), 29) AS INTEGER) AS bin,
       round(any_value(lo + least(greatest(floor((value - lo) / width), 0), 29) * width), 4) AS lower,
       round(any_value(lo + (least(greatest(floor((value - lo) / width), 0), 29) + 1) * width), 4) AS upper,
       count(*) AS n, round(count(*) / any_value(total * width), 6) AS density
FROM events e JOIN s USING (event_type) GROUP BY 1, 2""")
def histogram(spark, folder):
    out = density_histogram(table(spark, folder, "events"), ["event_type"], "value")
    return rounded(rounded(out, "lower", "upper"), "density", digits=6)


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _corr_sql(a, b):
    if a == b:
        return f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0::DOUBLE AS corr"
    return f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS corr FROM lineitem"


@query("a14_correlation_matrix", " UNION ALL ".join(_corr_sql(a, b) for a in NUMBERS for b in NUMBERS))
def correlation(spark, folder):
    return rounded(filters.correlation_table(table(spark, folder, "lineitem"), NUMBERS), "corr")


@query("a15_covariance", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_pop({a}, {b}), 4) AS cov FROM lineitem" for a in NUMBERS for b in NUMBERS))
def covariance(spark, folder):
    return rounded(scale.covariance_table(table(spark, folder, "lineitem"), NUMBERS), "cov")


@query("a15_precision", """
WITH c AS (SELECT var_pop(p_size) AS a, covar_pop(p_size, p_retailprice) AS b, var_pop(p_retailprice) AS d FROM part)
SELECT round(d / (a * d - b * b), 6) AS p00, round(-b / (a * d - b * b), 6) AS p01, round(a / (a * d - b * b), 6) AS p11 FROM c""")
def precision(spark, folder):
    inv = scale.precision(scale.covariance(table(spark, folder, "part"), ["p_size", "p_retailprice"]))
    return rounded(spark.createDataFrame([(float(inv[0, 0]), float(inv[0, 1]), float(inv[1, 1]))], "p00 double, p01 double, p11 double"),
                   "p00", "p01", "p11", digits=6)


def _profile_sql(c):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS n_null, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS p25, "
            f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75 FROM lineitem")


@query("a16_profile", " UNION ALL ".join(_profile_sql(c) for c in NUMBERS))
def profile(spark, folder):
    out = diagnose.profile(table(spark, folder, "lineitem"), NUMBERS)
    return rounded(out, "mean", "std", "min", "max", "p25", "p50", "p75")


@query("a16_schema_info", """
SELECT * FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), (3, 'c_acctbal', 'double'),
 (4, 'c_mktsegment', 'string')) v(position, "column", type), (SELECT count(*) - count(c_custkey) AS n_null FROM customer)""")
def schema_info(spark, folder):
    return diagnose.schema_info(table(spark, folder, "customer"))


@query("a24_principal_components")
def components(spark, folder):
    out = diagnose.pca_two(scale.standardise(table(spark, folder, "lineitem").select("l_orderkey", *NUMBERS), NUMBERS),
                           [f"z_{c}" for c in NUMBERS])
    return rounded(out.select("l_orderkey", "PC1", "PC2"), "PC1", "PC2")


@query("w1_average_rank", """
SELECT l_returnflag, l_quantity, count(*) AS n, any_value(r) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank
FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1, 2""")
def ranks(spark, folder):
    out = average_ranks(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity")
    return longs(out.select("l_returnflag", "l_quantity", "n", F.col("avg_rank").cast("double").alias("avg_rank")), "n")


@query("o3_mixed_direction_sort", """
SELECT p_brand AS silhouette_group, p_size, count(*) AS n, round(max(p_retailprice), 4) AS top FROM part GROUP BY 1, 2
HAVING max(p_retailprice) > 950 ORDER BY top DESC, p_size DESC, n""")
def mixed_sort(spark, folder):
    rows = table(spark, folder, "part").groupBy(F.col("p_brand").alias("silhouette_group"), "p_size").agg(
        F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("top")).where(F.col("top") > 950)
    return rounded(rows.orderBy(F.desc("top"), F.desc("p_size"), F.asc("n")), "top")


@query("o4_sorted_value_counts", "SELECT quality AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality ORDER BY quality")
def sorted_counts(spark, folder):
    return rounded(diagnose.value_counts(table(spark, folder, "labels"), "quality").orderBy("value"), "share", digits=6)
