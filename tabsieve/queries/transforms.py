"""Projections, encodings, column dropping, sampling and table generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.functions.ranking import number_rows
from tabsieve.operators import encode, filters, generate, scale
from tabsieve.operators.compare import tagged_union, union_all
from tabsieve.operators.neighbours import sample_rows
from tabsieve.operators.search import parameter_grid
from tabsieve.queries.registry import longs, query, rounded, table, uniform_sql
from tabsieve.sources.tables import with_row_id


@query("p1_drop_columns", "SELECT p_partkey, p_type, p_size FROM part")
def drop_columns(spark, folder):
    return table(spark, folder, "part").drop("p_name", "p_brand", "p_retailprice", "not_there")


@query("p2_project_like", "SELECT s_suppkey AS c_custkey, s_acctbal AS c_acctbal, s_nationkey AS c_nationkey FROM supplier")
def project_like(spark, folder):
    base = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    other = table(spark, folder, "supplier").select(F.col("s_name").alias("extra"), F.col("s_nationkey").alias("c_nationkey"),
                                                    F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return encode.project_like(other, base)


@query("p3_cast_columns", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(floor(p_retailprice) AS INTEGER) AS p_retailprice FROM part")
def cast_columns(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return encode.cast_columns(encode.cast_columns(p, ["p_size"], "double"), ["p_retailprice"], "int")


@query("p4_columns_by_type", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def columns_by_type(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(*encode.columns_of_type(lines, "numeric"))


HOLES = ("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand, "
         "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size, "
         "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part")


def with_holes(spark, folder):
    hole = lambda c, m: F.when(F.col("p_partkey") % m != 0, F.col(c)).alias(c)
    return table(spark, folder, "part").select("p_partkey", hole("p_brand", 7), hole("p_size", 5), hole("p_retailprice", 3))


def _mode(c):
    return f"(SELECT {c} FROM h WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("p5_most_frequent_imputation", f"""
WITH h AS ({HOLES})
SELECT p_partkey, {", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in ("p_brand", "p_size", "p_retailprice"))} FROM h""")
def impute(spark, folder):
    return encode.impute_most_frequent(with_holes(spark, folder), ["p_brand", "p_size", "p_retailprice"])


def _rank(t, c):
    return f"(SELECT {c} AS k, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL))"


@query("p6_ordinal_encode", f"""
SELECT p.p_partkey, n.code AS p_name, b.code AS p_brand, t.code AS p_type, p.p_size, p.p_retailprice FROM part p
JOIN {_rank("part", "p_name")} n ON p.p_name = n.k JOIN {_rank("part", "p_brand")} b ON p.p_brand = b.k
JOIN {_rank("part", "p_type")} t ON p.p_type = t.k""")
def ordinal(spark, folder):
    p = table(spark, folder, "part")
    return encode.ordinal_encode(p, encode.category_mapping(p))


@query("p7_ordinal_decode", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type, p_size FROM part")
def decode(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    mapping = encode.category_mapping(p)
    coded = encode.ordinal_encode(p, mapping).withColumn("p_brand", F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")))
    return encode.ordinal_decode(coded, mapping)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("p8_one_hot_encode", f"""
SELECT c_custkey, c_acctbal, {", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_{s}" for s in SEGMENTS)}
FROM customer""")
def one_hot(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return encode.one_hot_encode(c, encode.category_mapping(c, ["c_mktsegment"]))


@query("p9_one_hot_decode", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def one_hot_back(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    mapping = encode.category_mapping(c, ["c_mktsegment"])
    return encode.one_hot_decode(encode.one_hot_encode(c, mapping), mapping)


@query("p8_one_hot_slots", f"""
SELECT o_orderkey, n.c + n.p AS size, concat_ws(',', CAST(c.code AS BIGINT), CAST(n.c + p.code AS BIGINT)) AS slots
FROM orders JOIN (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders)) c
     ON CAST(o_custkey AS VARCHAR) = c.k JOIN {_rank("orders", "o_orderpriority")} p ON o_orderpriority = p.k,
     (SELECT count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders) n""")
def sparse_one_hot(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = encode.one_hot_slots(o, encode.category_mapping(o, ["o_custkey", "o_orderpriority"]))
    return out.select("o_orderkey", F.col("one_hot.size").alias("size"), F.array_join(F.col("one_hot.slots").cast("array<string>"), ",").alias("slots"))


@query("p9_one_hot_slots_decode", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders")
def sparse_one_hot_back(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    mapping = encode.category_mapping(o, ["o_custkey", "o_orderpriority"])
    return encode.one_hot_slots_decode(encode.one_hot_slots(o, mapping), mapping)


@query("p10_encode_against_reference", f"""
WITH d AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'Brand#X' ELSE p_brand END AS p_brand,
                  CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_type END AS p_type, CASE WHEN p_size = 10 THEN NULL ELSE p_size END AS p_size FROM part)
SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, coalesce(b.code, -1.0) AS p_brand, coalesce(t.code, -1.0) AS p_type,
       coalesce(CAST(p_size AS DOUBLE), -1.0) AS p_size
FROM d LEFT JOIN {_rank("part", "p_brand")} b ON d.p_brand = b.k LEFT JOIN {_rank("part", "p_type")} t ON d.p_type = t.k""")
def against_reference(spark, folder):
    ref = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    odd = ref.select("p_partkey", F.when(F.col("p_size") > 40, "Brand#X").otherwise(F.col("p_brand")).alias("p_brand"),
                     F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("p_type"),
                     F.when(F.col("p_size") != 10, F.col("p_size")).alias("p_size"))
    return encode.encode_against(odd, ref)


_HIGH = "(SELECT * FROM orders WHERE o_totalprice > 450000 AND o_orderpriority <> '5-LOW')"


@query("p11_shared_label_codes", f"""
SELECT o_orderkey, o_orderpriority, coalesce(r.code, -1.0) AS label FROM orders o LEFT JOIN {_rank(_HIGH, "o_orderpriority")} r ON o.o_orderpriority = r.k""")
def shared_labels(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    seen = o.where((F.col("o_totalprice") > 450000) & (F.col("o_orderpriority") != "5-LOW"))
    return encode.shared_label_codes(seen, o.drop("o_totalprice"), "o_orderpriority")


@query("p12_label_encode", f"""
WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_brand FROM part)
SELECT s.p_partkey, a.code AS p_size, b.code AS p_brand FROM s JOIN {_rank("s", "p_size")} a ON s.p_size = a.k JOIN {_rank("s", "p_brand")} b ON s.p_brand = b.k""")
def label_codes(spark, folder):
    return encode.label_encode(table(spark, folder, "part").select("p_partkey", "p_size", "p_brand"), ["p_size", "p_brand"])


@query("p13_standardise", """
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 4) AS z_p_size,
       round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 4) AS z_p_retailprice, 0.0::DOUBLE AS z_flat FROM part""")
def zscore(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(3.7).alias("flat"))
    out = scale.standardise(p, ["p_size", "p_retailprice", "flat"]).drop("p_size", "p_retailprice", "flat")
    return rounded(out, "z_p_size", "z_p_retailprice")


@query("p14_row_key", "SELECT p_partkey, p_brand || '|' || p_size || '|' || printf('%.6f', round(p_retailprice, 6)) AS row_key FROM part")
def keys_of_rows(spark, folder):
    return encode.row_key(table(spark, folder, "part"), ["p_brand", "p_size", "p_retailprice"]).select("p_partkey", "row_key")


@query("p15_drop_null_rows", f"SELECT * FROM ({HOLES}) WHERE p_brand IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def without_nulls(spark, folder):
    return encode.drop_null_rows(with_holes(spark, folder))


@query("f4_drop_constant_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def constants(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("one"), F.lit("x").alias("same"))
    return filters.drop_constant_columns(o)


@query("f5_drop_duplicate_columns", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount FROM lineitem")
def duplicates(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount",
                                                    (F.col("l_quantity") * 2 + 1).alias("twice"), (-F.col("l_discount")).alias("minus"))
    return filters.drop_duplicate_columns(lines)


@query("j10_member_semi_join", """
SELECT p_partkey, p_brand, p_size FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_type = 'PROMO' AND a.p_brand = b.p_brand AND a.p_size = b.p_size)""")
def semi(spark, folder):
    p = table(spark, folder, "part")
    cols = ["p_brand", "p_size"]
    kept = encode.row_key(p.where(F.col("p_type") == "PROMO"), cols).select("row_key").distinct()
    return encode.row_key(p, cols).join(kept, "row_key", "left_semi").select("p_partkey", *cols)


SPLIT_SQL = """
SELECT o_orderkey, o_totalprice, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey)
  <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'holdout' END AS part FROM orders"""


@query("j11_holdout_anti_join", f"SELECT o_orderkey, o_totalprice FROM ({SPLIT_SQL}) WHERE part = 'holdout'")
def holdout(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    train = generate.split_train_holdout(o, "o_orderkey").where(F.col("part") == "train")
    return o.join(train, "o_orderkey", "left_anti")


@query("g1_seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('0|' || o_orderkey), o_orderkey LIMIT 1200")
def sample(spark, folder):
    return sample_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1200)


@query("g2_train_holdout_split", SPLIT_SQL)
def split(spark, folder):
    return generate.split_train_holdout(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


def _marginal_sql(c, seed="42"):
    return f"""(SELECT g.range AS gen_id, v.{c} FROM range((SELECT count(*) FROM part)) g JOIN (
      SELECT {c}, (sum(n) OVER (ORDER BY {c}) - n) / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY {c}) / sum(n) OVER () AS hi
      FROM (SELECT {c}, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY {c})) v
      ON {uniform_sql(seed + "|" + c, "g.range")} >= v.lo AND {uniform_sql(seed + "|" + c, "g.range")} < v.hi)"""


@query("g3_independent_marginals", f"SELECT a.gen_id, a.p_size, b.p_type FROM {_marginal_sql('p_size')} a JOIN {_marginal_sql('p_type')} b ON a.gen_id = b.gen_id")
def marginals(spark, folder):
    p = table(spark, folder, "part")
    return generate.independent_marginals(p, ["p_size", "p_type"], p.count())


@query("g4_uniform_sampler", f"""
SELECT g.range AS gen_id, round(l.lo + {uniform_sql("42|p_retailprice", "g.range")} * (l.hi - l.lo), 4) AS p_retailprice, t.p_type
FROM range((SELECT count(*) FROM part)) g, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) l
JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)) t
  ON floor({uniform_sql("42|p_type", "g.range")} * t.n) + 1 = t.rn""")
def uniform(spark, folder):
    p = table(spark, folder, "part")
    return rounded(generate.uniform_sampler(p, ["p_retailprice"], ["p_type"], p.count()), "p_retailprice")


BOOT_SQL = f"""
SELECT g.range AS gen_id, c.c_custkey, c.c_nationkey, c.c_mktsegment, c.c_acctbal FROM range((SELECT count(*) FROM customer)) g
JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n FROM customer) c
  ON floor({uniform_sql("42", "g.range")} * c.n) + 1 = c.rn"""


def bootstrapped_customers(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return generate.bootstrap(c, "c_custkey", c.count())


@query("g5_bootstrap", BOOT_SQL)
def boot(spark, folder):
    return bootstrapped_customers(spark, folder)


@query("g6_bayesian_network")
def network(spark, folder):
    p = table(spark, folder, "part")
    return generate.bayesian_network(p, ["p_type", "p_brand", "p_size"], p.count(), bins=60)


@query("g6_mutual_information", """
WITH n AS (SELECT count(*) AS n FROM part), b AS (SELECT p_brand, count(*) AS nb FROM part GROUP BY 1), t AS (SELECT p_type, count(*) AS nt FROM part GROUP BY 1),
s AS (SELECT p_size, count(*) AS ns FROM part GROUP BY 1)
SELECT 'p_type' AS col_a, 'p_brand' AS col_b, round(sum(c / n.n * ln(c * n.n / (nt * nb))), 4) AS mi
FROM (SELECT p_type, p_brand, CAST(count(*) AS DOUBLE) AS c FROM part GROUP BY 1, 2) JOIN b USING (p_brand) JOIN t USING (p_type), n
UNION ALL SELECT 'p_type', 'p_size', round(sum(c / n.n * ln(c * n.n / (nt * ns))), 4)
FROM (SELECT p_type, p_size, CAST(count(*) AS DOUBLE) AS c FROM part GROUP BY 1, 2) JOIN s USING (p_size) JOIN t USING (p_type), n
UNION ALL SELECT 'p_brand', 'p_size', round(sum(c / n.n * ln(c * n.n / (nb * ns))), 4)
FROM (SELECT p_brand, p_size, CAST(count(*) AS DOUBLE) AS c FROM part GROUP BY 1, 2) JOIN s USING (p_size) JOIN b USING (p_brand), n""")
def mutual_information(spark, folder):
    return rounded(generate.mutual_information(table(spark, folder, "part"), ["p_type", "p_brand", "p_size"]), "mi")


@query("u1_union_all", """
SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier""")
def union(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return union_all([c, s])


@query("u2_tagged_union", """
SELECT event_id, value, CASE WHEN value <= 100 THEN event_type END AS event_type, value > 100 AS is_outlier FROM events""")
def tagged(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value", "event_type")
    return tagged_union(e.where(F.col("value") <= 100), e.where(F.col("value") > 100).drop("event_type"))


@query("u3_distinct_labels", "SELECT DISTINCT quality * 2 + toxic - 1 AS label FROM labels WHERE quality * 2 + toxic - 1 <> -1")
def label_set(spark, folder):
    return table(spark, folder, "labels").select((F.col("quality") * 2 + F.col("toxic") - 1).alias("label")).distinct().where(F.col("label") != -1)


@query("r3_parameter_grid", """
SELECT s.source AS dataset, e.eps, m.mp, count(*) AS n FROM documents s, (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS eps) e,
(SELECT unnest([3, 5, 10]) AS mp) m GROUP BY ALL""")
def grid(spark, folder):
    sizes = table(spark, folder, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    names = [r[0] for r in sizes.select("dataset").orderBy("dataset").collect()]
    return parameter_grid(spark, dataset=names, eps=[0.1, 0.2, 0.3], mp=[3, 5, 10]).join(F.broadcast(sizes), "dataset")


@query("w4_category_ranks", """
SELECT source, lang, dense_rank() OVER (PARTITION BY lang ORDER BY source) AS position FROM (SELECT DISTINCT lang, source FROM documents)""")
def category_ranks(spark, folder):
    seen = table(spark, folder, "documents").select("lang", "source").distinct()
    return longs(number_rows(seen, ["source"], ["lang"], "position"), "position")


@query("with_row_id", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity) AS row_id, l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def row_ids(spark, folder):
    return with_row_id(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
