"""Similarity joins, nearest neighbours and cross-table matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import neighbours, scale
from tabsieve.operators.marginal import common_rows
from tabsieve.operators.proximity import scaled_pair
from tabsieve.queries.registry import distance_sql, query, rounded, table, z_sql

PART = ("p_size", "p_retailprice")
ZPART = z_sql("part", "p_partkey", PART)


def part_z(spark, folder):
    p = table(spark, folder, "part")
    return scale.standardise(p, PART)


def _degrees_sql(points, condition):
    return f"WITH p AS MATERIALIZED ({points}) SELECT a.id AS p_partkey, count(*) AS n_neighbours FROM p a JOIN p b ON {condition} GROUP BY a.id"


@query("j1_eps_join_euclidean", _degrees_sql(ZPART, distance_sql(2) + " <= 0.1"))
def eps_join(spark, folder):
    return neighbours.eps_neighbour_counts(part_z(spark, folder), "p_partkey", ["z_p_size", "z_p_retailprice"], 0.1)


@query("j1_eps_pairs", f"""
WITH p AS MATERIALIZED (SELECT min(id) AS id, count(*) AS n, z0, z1 FROM ({ZPART}) GROUP BY z0, z1)
SELECT a.id AS id_a, b.id AS id_b, round({distance_sql(2)}, 4) AS distance, a.n AS copies_a, b.n AS copies_b
FROM p a JOIN p b ON a.id < b.id AND {distance_sql(2)} <= 0.05""")
def eps_pairs(spark, folder):
    return rounded(neighbours.eps_pairs(part_z(spark, folder), "p_partkey", ["z_p_size", "z_p_retailprice"], 0.05), "distance")


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


# the same neighbour counts by a cell join: cells as wide as eps, one side spread over adjacent cells
_Z4 = z_sql("(SELECT l_quantity, l_extendedprice, l_discount, l_tax, row_number() OVER () AS rid FROM lineitem)", "rid", LINE)


@query("j1_eps_join_lineitem", f"""
WITH z AS MATERIALIZED ({_Z4}), p AS MATERIALIZED (SELECT count(*) AS w, min(id) AS id, z0, z1, z2, z3, CAST(floor(z0 / 0.3) AS INTEGER) AS c0, CAST(floor(z1 / 0.3) AS INTEGER) AS c1,
  CAST(floor(z2 / 0.3) AS INTEGER) AS c2, CAST(floor(z3 / 0.3) AS INTEGER) AS c3 FROM z GROUP BY z0, z1, z2, z3),
q AS (SELECT p.* REPLACE (c0 + a.o AS c0, c1 + b.o AS c1, c2 + c.o AS c2, c3 + d.o AS c3) FROM p, (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) b(o),
  (VALUES (-1), (0), (1)) c(o), (VALUES (-1), (0), (1)) d(o)),
n AS (SELECT a.id, any_value(a.w) AS w, sum(b.w) AS n FROM q a JOIN p b ON a.c0 = b.c0 AND a.c1 = b.c1 AND a.c2 = b.c2 AND a.c3 = b.c3
  WHERE {distance_sql(4)} <= 0.3 GROUP BY a.id)
SELECT CAST(n AS BIGINT) AS n_neighbours, CAST(sum(w) AS BIGINT) AS n_rows FROM n GROUP BY n""")
def eps_join_lines(spark, folder):
    """Neighbour counts over the largest table (4 columns), summed up per count."""
    lines = table(spark, folder, "lineitem").select(*LINE)
    return neighbours.eps_neighbour_histogram(scale.standardise(lines, LINE), [f"z_{c}" for c in LINE], 0.3)


@query("j2_eps_join_manhattan", _degrees_sql(ZPART, distance_sql(2, "manhattan") + " <= 0.1"))
def eps_join_l1(spark, folder):
    return neighbours.eps_neighbour_counts(part_z(spark, folder), "p_partkey", ["z_p_size", "z_p_retailprice"], 0.1, "manhattan")


@query("j3_eps_join_mahalanobis", f"""
WITH p AS MATERIALIZED ({ZPART}), c AS (SELECT var_pop(z0) AS a, covar_pop(z0, z1) AS b, var_pop(z1) AS d FROM p)
SELECT a.id AS p_partkey, count(*) AS n_neighbours FROM p a, p b, c
WHERE (c.d * (a.z0 - b.z0) * (a.z0 - b.z0) - 2 * c.b * (a.z0 - b.z0) * (a.z1 - b.z1) + c.a * (a.z1 - b.z1) * (a.z1 - b.z1))
      / (c.a * c.d - c.b * c.b) <= 0.1 * 0.1 GROUP BY a.id""")
def eps_join_mahalanobis(spark, folder):
    return neighbours.eps_neighbour_counts(part_z(spark, folder), "p_partkey", ["z_p_size", "z_p_retailprice"], 0.1, "mahalanobis")


@query("j4_median_pair_distance", f"""
WITH s AS MATERIALIZED (SELECT * FROM ({ZPART}) ORDER BY md5('0|' || id), id LIMIT 1200)
SELECT round(median({distance_sql(2)}), 4) AS median_distance FROM s a JOIN s b ON a.id < b.id""")
def pair_median(spark, folder):
    m = neighbours.median_pair_distance(part_z(spark, folder), "p_partkey", ["z_p_size", "z_p_retailprice"])
    return rounded(spark.createDataFrame([(m,)], "median_distance double"), "median_distance")


def vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"feature_{i}") for i in range(64)])


FEATURES = [f"feature_{i}" for i in range(64)]


@query("j5_knn_self_join", """
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.e, b.e) AS d FROM v a, v b)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS INTEGER) AS rank, neighbour, round(d, 4) AS distance
FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) <= 6""")
def knn_self(spark, folder):
    return rounded(neighbours.knn(vectors(spark, folder), "vec_id", FEATURES, 6), "distance")


CUST_U = """
r AS (SELECT min(c_nationkey) AS l0, max(c_nationkey) - min(c_nationkey) AS w0, min(c_acctbal) AS l1, max(c_acctbal) - min(c_acctbal) AS w1 FROM customer),
re AS MATERIALIZED (SELECT c_custkey AS id, (c_nationkey - l0) / w0 AS z0, (c_acctbal - l1) / w1 AS z1 FROM customer, r),
sy AS MATERIALIZED (SELECT s_suppkey AS id, (s_nationkey - l0) / w0 AS z0, (s_acctbal - l1) / w1 AS z1 FROM supplier, r)"""


def customer_supplier(spark, folder):
    """Real = customers, synthetic = suppliers, over nation and balance."""
    real = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    syn = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"),
                                                  F.col("s_acctbal").alias("c_acctbal"))
    return real, syn


@query("j6_cross_table_nearest", f"""
WITH {CUST_U}, d AS (SELECT a.id, b.id AS nid, {distance_sql(2)} AS d FROM re a, sy b)
SELECT id AS pid, min_by(nid, (d, nid)) AS nid, round(min(d), 4) AS distance FROM d GROUP BY id""")
def cross_nearest(spark, folder):
    real, syn = customer_supplier(spark, folder)
    pair = scaled_pair(real, syn, "c_custkey", "c_custkey", ["c_nationkey", "c_acctbal"])
    return rounded(pair.real_rows_to_syn(), "distance")


@query("j6_cross_table_knn", """
WITH d AS (SELECT c_custkey, s_suppkey AS neighbour, abs(c_acctbal - s_acctbal) AS d FROM customer, supplier)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY d, neighbour) AS INTEGER) AS rank, neighbour, round(d, 4) AS distance
FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, neighbour) <= 3""")
def cross_knn(spark, folder):
    real, syn = customer_supplier(spark, folder)
    return rounded(neighbours.knn(real, "c_custkey", ["c_acctbal"], 3, syn, "c_custkey"), "distance")


@query("j13_common_rows", """
SELECT round(count(*) FILTER (WHERE s.q IS NOT NULL) / count(*), 6) AS value
FROM (SELECT DISTINCT l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem WHERE l_linestatus = 'O') r
LEFT JOIN (SELECT DISTINCT l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem WHERE l_linestatus = 'F') s ON r.q = s.q AND r.d = s.d AND r.t = s.t""")
def common(spark, folder):
    lines = table(spark, folder, "lineitem")
    out = common_rows(lines.where(F.col("l_linestatus") == "O"), lines.where(F.col("l_linestatus") == "F"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(out, "value", digits=6)


@query("d7_k_distance_curve", f"""
WITH p AS MATERIALIZED ({ZPART}), d AS (SELECT a.id, {distance_sql(2)} AS d FROM p a, p b),
k AS (SELECT id, d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 5)
SELECT row_number() OVER (ORDER BY d, id) AS position, round(d, 4) AS distance FROM k""")
def curve(spark, folder):
    out = neighbours.k_distance_curve(part_z(spark, folder), "p_partkey", ["z_p_size", "z_p_retailprice"], 5)
    return rounded(out, "distance")
