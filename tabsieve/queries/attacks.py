"""Attribute- and membership-inference attacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import attack, utility
from tabsieve.operators.encode import shared_label_codes
from tabsieve.operators.filters import known_label_rows
from tabsieve.operators.generate import split_train_holdout
from tabsieve.plans.membership import holdout_slices, membership_inference
from tabsieve.plans.sweep import attack_sweep
from tabsieve.queries.neighbourhoods import customer_supplier
from tabsieve.queries.registry import query, rounded, table
from tabsieve.queries.transforms import SPLIT_SQL

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def line_arms(spark, folder):
    """Real = open lines, synthetic = finished lines."""
    t = table(spark, folder, "lineitem").select("l_linestatus", *COLUMNS)
    return t.where("l_linestatus = 'O'").drop("l_linestatus"), t.where("l_linestatus = 'F'").drop("l_linestatus")


@query("k1_k3_attribute_inference")
def attribute(spark, folder):
    real, syn = line_arms(spark, folder)
    return attack.attribute_inference(real, syn, "l_returnflag", ("logreg", "rf"))


@query("k10_attribute_leakage")
def leakage(spark, folder):
    real, syn = line_arms(spark, folder)
    two = lambda d: d.withColumn("l_returnflag", F.when(F.col("l_returnflag") == "N", "N").otherwise("X"))
    return attack.attribute_inference(two(real), two(syn), "l_returnflag", ("linear", "mlp", "xgb"))


@query("k4_degenerate_attack", """
SELECT 'l_returnflag' AS attribute, count(*) AS n_classes, round(max(n) / sum(n), 4) AS baseline, true AS degenerate, 'n/a' AS model,
  round(max(n) / sum(n), 4) AS acc, round(1 / count(*), 4) AS bal_acc, 0.0::DOUBLE AS advantage FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)""")
def degenerate(spark, folder):
    t = table(spark, folder, "lineitem")
    return attack.degenerate_rows(t, t.withColumn("l_returnflag", F.lit("N")), "l_returnflag")


@query("k5_majority_baseline", """
SELECT round(max(n) / sum(n), 4) AS baseline, count(*) AS n_classes FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def baseline(spark, folder):
    out = attack.majority_share(table(spark, folder, "events"), "event_type")
    return rounded(out.select("baseline", "n_classes"), "baseline")


@query("f9_known_label_rows", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 450000 AND o_orderpriority <> '5-LOW')""")
def known(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    seen = o.where((F.col("o_totalprice") > 450000) & (F.col("o_orderpriority") != "5-LOW"))
    return known_label_rows(shared_label_codes(seen, o.drop("o_totalprice"), "o_orderpriority")).drop("label")


@query("a26_accuracy_scores", """
WITH c AS (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = CASE WHEN o_totalprice > 250000 THEN 'O' WHEN o_totalprice > 100000 THEN 'F' ELSE 'P' END) AS h
  FROM orders GROUP BY 1)
SELECT round(sum(h) / sum(n), 6) AS acc, round(avg(h / n), 6) AS bal_acc, round(sum(h) / sum(n) - max(n) / sum(n), 6) AS advantage FROM c""")
def accuracy(spark, folder):
    o = table(spark, folder, "orders")
    guess = F.when(F.col("o_totalprice") > 250000, "O").when(F.col("o_totalprice") > 100000, "F").otherwise("P")
    got = utility.accuracy_scores(o.withColumn("guess", guess), "o_orderstatus", "guess")
    base = attack.majority_share(o, "o_orderstatus").first()["baseline"]
    return rounded(got.withColumn("advantage", F.col("acc") - F.lit(base)), "acc", "bal_acc", "advantage", digits=6)


@query("k6_attack_sweep")
def sweep(spark, folder):
    real, syn = line_arms(spark, folder)
    jobs = spark.createDataFrame([("lines", "base", "finished"), ("lines", "sanitised", "constant"), ("lines", "base", "done")],
                                 "dataset string, arm string, synth string")
    done = jobs.where(F.col("synth") == "done")

    def load(job):
        s = syn if job["synth"] == "finished" else syn.withColumn("l_returnflag", F.lit("N"))
        return real, s, ["l_returnflag", "missing_column"]

    return attack_sweep(jobs, load, ("logreg", "rf"), done)


@query("k7_membership_tables", f"""
WITH p AS (SELECT o.*, s.part FROM orders o JOIN ({SPLIT_SQL}) s ON o.o_orderkey = s.o_orderkey)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN part = 'holdout' THEN 'holdout' ELSE 'member' END AS side
FROM p WHERE part = 'holdout' OR o_totalprice <= 400000""")
def membership(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit(1.0).alias("one"),
                                              (F.col("o_totalprice") * 2).alias("twice"))
    members, hold, _ = attack.membership_tables(o, o.where(F.col("o_totalprice") <= 400000), "o_orderkey")
    return members.withColumn("side", F.lit("member")).unionByName(hold.withColumn("side", F.lit("holdout")))


PARTS = """
al AS MATERIALIZED (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS z0, c_acctbal AS z1, CASE WHEN row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey)
  <= floor(count(*) OVER () * 0.7) THEN 1 ELSE 0 END AS train FROM customer),
ho AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('slice|' || id), id) AS r, count(*) OVER () // 2 AS half FROM al WHERE train = 0),
sp AS MATERIALIZED (SELECT id, z0, z1, 1 AS member FROM al WHERE train = 1 AND KEPT UNION ALL SELECT id, z0, z1, 0 FROM ho WHERE r <= half),
sy AS MATERIALIZED (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS z0, s_acctbal AS z1 FROM supplier),
rf AS MATERIALIZED (SELECT id, z0, z1 FROM ho WHERE r > half AND r <= 2 * half)"""


def _kde(src, name):
    q = "(c.d * (x.z0 - y.z0) * (x.z0 - y.z0) - 2 * c.b * (x.z0 - y.z0) * (x.z1 - y.z1) + c.a * (x.z1 - y.z1) * (x.z1 - y.z1)) / (c.a * c.d - c.b * c.b)"
    return f"""{name} AS MATERIALIZED (SELECT x.id, sum(exp(-0.5 * {q} / power(c.n, -1.0 / 3))) / any_value(c.n * sqrt(power(2 * pi() * power(c.n, -1.0 / 3), 2) * (c.a * c.d - c.b * c.b))) AS p
  FROM sp x, {src} y, (SELECT count(*)::DOUBLE AS n, var_samp(z0) AS a, covar_samp(z0, z1) AS b, var_samp(z1) AS d FROM {src}) c GROUP BY x.id)"""


KDE = f"WITH {PARTS.replace('KEPT', 'true')}, {_kde('sy', 'ps')}, {_kde('rf', 'pr')}, sc AS MATERIALIZED (SELECT sp.id, sp.member, ps.p / (pr.p + 1e-10) AS score FROM sp JOIN ps USING (id) JOIN pr USING (id))"
SCORES = """, rk AS (SELECT member, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r, median(score) OVER () AS m FROM sc)
SELECT round((sum(r) FILTER (WHERE member = 1) - sum(member) * (sum(member) + 1) / 2) / (sum(member) * (count(*) - sum(member))), 4) AS auroc,
  round(avg(CASE WHEN (score > m) = (member = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, CAST(sum(member) AS BIGINT) AS n_pos, CAST(count(*) - sum(member) AS BIGINT) AS n_neg FROM rk"""


def membership_inputs(spark, folder):
    """Members, non-members and reference rows, which share no row, and the synthetic table."""
    real, syn = customer_supplier(spark, folder)
    parts = split_train_holdout(real, "c_custkey")
    hold = parts.where("part = 'holdout'").drop("part")
    outsiders, reference = holdout_slices(hold, "c_custkey", hold.count() // 2)
    return parts.where("part = 'train'").drop("part"), outsiders, reference, syn


@query("k8_domias_kde", KDE + SCORES)
def domias(spark, folder):
    """Members = customers of the training part, outsiders and reference = the halves of the holdout, synthetic = suppliers."""
    members, outsiders, reference, syn = membership_inputs(spark, folder)
    scored = attack.domias(members, outsiders, syn, reference, "c_custkey", "c_custkey", ["c_nationkey", "c_acctbal"])
    return rounded(attack.membership_scores(scored), "auroc", "accuracy")


@query("k9_domias_gaussian_prior", f"""WITH {PARTS.replace('KEPT', 'true')}, {_kde('sy', 'ps')}, pr AS (SELECT x.id,
  exp(-0.5 * (c.d * (x.z0 - c.m0) * (x.z0 - c.m0) - 2 * c.b * (x.z0 - c.m0) * (x.z1 - c.m1) + c.a * (x.z1 - c.m1) * (x.z1 - c.m1)) / (c.a * c.d - c.b * c.b))
  / sqrt(power(2 * pi(), 2) * (c.a * c.d - c.b * c.b)) AS p
  FROM sp x, (SELECT avg(z0) AS m0, avg(z1) AS m1, var_samp(z0) AS a, covar_samp(z0, z1) AS b, var_samp(z1) AS d FROM rf) c),
sc AS MATERIALIZED (SELECT sp.id, sp.member, ps.p / (pr.p + 1e-10) AS score FROM sp JOIN ps USING (id) JOIN pr USING (id))""" + SCORES)
def domias_prior(spark, folder):
    members, outsiders, reference, syn = membership_inputs(spark, folder)
    scored = attack.domias(members, outsiders, syn, reference, "c_custkey", "c_custkey", ["c_nationkey", "c_acctbal"], prior="gaussian")
    return rounded(attack.membership_scores(scored), "auroc", "accuracy")


@query("k7_membership_inference", KDE.replace("train = 1 AND true", "train = 1 AND z1 <= 9000") + SCORES.replace("SELECT round(", """, res AS (SELECT round(""", 1) + """)
SELECT 'customer' AS dataset, n_pos AS n_members, n_neg AS n_nonmembers, n_neg AS reference_size, 0 AS n_cols_dropped, auroc, accuracy, 'ok' AS status FROM res
UNION ALL SELECT 'nation', CAST(floor(count(*) * 0.7) AS BIGINT), CAST((count(*) - floor(count(*) * 0.7)) // 2 AS BIGINT),
  CAST((count(*) - floor(count(*) * 0.7)) // 2 AS BIGINT), 0, NULL, NULL, 'too small' FROM nation""")
def membership_end_to_end(spark, folder):
    """Customers up to a balance are the arm; the nations are too few to be scored."""
    real, syn = customer_supplier(spark, folder)
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("n_regionkey"))
    big = membership_inference(real, real.where("c_acctbal <= 9000"), lambda _: syn, "c_custkey", "c_custkey")
    small = membership_inference(nation, nation, lambda m: m, "n_nationkey", "n_nationkey")
    both = big.withColumn("dataset", F.lit("customer")).unionByName(small.withColumn("dataset", F.lit("nation")))
    return rounded(both.drop("error"), "auroc", "accuracy")


@query("k8_auroc_by_ranks", """
WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc, CAST(sum(y) AS BIGINT) AS n_pos,
  CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM r""")
def auroc(spark, folder):
    t = table(spark, folder, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(utility.auroc_by_ranks(t, "l_quantity", "y"), "auroc", digits=6)
