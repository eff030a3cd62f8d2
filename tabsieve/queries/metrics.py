"""Real-against-synthetic metrics.

Neighbour metrics compare all customers (real) with all suppliers (synthetic) on
nation and balance; marginal metrics compare open with finished order lines;
group metrics compare customers with a bootstrap of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import marginal, privacy, proximity, scale, utility
from tabsieve.plans.suite import FAMILIES, evaluate, two_arms
from tabsieve.queries.neighbourhoods import CUST_U, customer_supplier
from tabsieve.queries.registry import distance_sql, query, rounded, table
from tabsieve.queries.transforms import BOOT_SQL, bootstrapped_customers
from tabsieve.operators.generate import bootstrap
from tabsieve.spec import TableSpec

PAIR_COLUMNS = ["c_nationkey", "c_acctbal"]
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL = [*NUM, "l_returnflag"]


def lines(spark, folder):
    t = table(spark, folder, "lineitem").select("l_linestatus", *ALL)
    return t.where(F.col("l_linestatus") == "O").drop("l_linestatus"), t.where(F.col("l_linestatus") == "F").drop("l_linestatus")


def scaled(spark, folder):
    real, syn = customer_supplier(spark, folder)
    return proximity.scaled_pair(real, syn, "c_custkey", "c_custkey", PAIR_COLUMNS)


_KIND = """CASE WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'text' ELSE 'number' END
  || CASE WHEN count(DISTINCT {c}) < 2 THEN 'constant' WHEN count(DISTINCT {c}) <= 20 THEN 'discrete' ELSE 'continuous' END"""
_SIDES = {"c_custkey": "s_name", "c_nationkey": "s_nationkey % 2", "c_acctbal": "s_acctbal", "c_mktsegment": "s_name", "1.0": "1.0"}


@query("m1_data_mismatch", "SELECT round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS value FROM (" + " UNION ALL ".join(
    f"SELECT (SELECT {_KIND.format(c=a)} FROM customer) AS a, (SELECT {_KIND.format(c=b)} FROM supplier) AS b" for a, b in _SIDES.items()) + ")")
def mismatch(spark, folder):
    """Customers against suppliers with a text key and a binary nation."""
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("seg"), F.lit(1.0).alias("one"))
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("c_custkey"), (F.col("s_nationkey") % 2).alias("c_nationkey"),
                                                F.col("s_acctbal").alias("c_acctbal"), F.col("s_name").alias("seg"), F.lit(1.0).alias("one"))
    return rounded(marginal.data_mismatch(c, s, c.columns), "value", digits=6)


@query("m2_common_rows_proportion", """
SELECT round(count(s.k) / count(*), 6) AS value FROM (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS g FROM customer) c
LEFT JOIN (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS g FROM customer WHERE c_acctbal > 5000) s ON c.k = s.k AND c.g = s.g""")
def common(spark, folder):
    c = table(spark, folder, "customer")
    return rounded(marginal.common_rows(c, c.where(F.col("c_acctbal") > 5000), ["c_nationkey", "c_mktsegment"]), "value", digits=6)


RS = f"""WITH {CUST_U},
rs AS MATERIALIZED (SELECT a.id, min({distance_sql(2)}) AS d, arg_min(b.id, {distance_sql(2)}) AS nid FROM re a, sy b GROUP BY a.id),
sr AS MATERIALIZED (SELECT b.id, min({distance_sql(2)}) AS d, arg_min(a.id, {distance_sql(2)}) AS nid FROM re a, sy b GROUP BY b.id),
rr AS MATERIALIZED (SELECT a.id, min({distance_sql(2)}) AS d FROM re a JOIN re b ON a.id <> b.id GROUP BY a.id),
nrm AS (SELECT id, (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS x FROM rs)"""


@query("m3_nearest_syn_neighbor_distance", f"{RS} SELECT round(avg(d), 6) AS value FROM rs")
def nearest(spark, folder):
    return rounded(proximity.nearest_neighbour_mean(scaled(spark, folder)), "value", digits=6)


@query("m4_close_values_probability", f"{RS} SELECT round(avg(CASE WHEN x <= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS value FROM nrm")
def close(spark, folder):
    return rounded(proximity.close_values(scaled(spark, folder)), "value", digits=6)


@query("m5_distant_values_probability", f"{RS} SELECT round(avg(CASE WHEN x >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS value FROM nrm")
def distant(spark, folder):
    return rounded(proximity.distant_values(scaled(spark, folder)), "value", digits=6)


def _bins_sql() -> str:
    parts = [f"""SELECT '{c}' AS col, CAST(CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS VARCHAR) AS bin, st FROM
      (SELECT l_linestatus AS st, {c} AS v, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM lineitem)""" for c in NUM]
    parts.append("SELECT 'l_returnflag', l_returnflag, l_linestatus FROM lineitem")
    return f"""b AS MATERIALIZED (SELECT col, bin, count(*) FILTER (WHERE st = 'O') AS r, count(*) FILTER (WHERE st = 'F') AS s FROM ({" UNION ALL ".join(parts)}) GROUP BY 1, 2),
n AS (SELECT col, sum(r) AS nr, sum(s) AS ns, count(*) AS k FROM b GROUP BY col),
p AS MATERIALIZED (SELECT b.*, nr, ns, r / nr AS p, s / ns AS q, (r + 1) / (nr + k) AS ps, (s + 1) / (ns + k) AS qs FROM b JOIN n USING (col))"""


BINS = f"WITH {_bins_sql()}"


@query("m6_jensenshannon", f"""{BINS} SELECT col AS "column", round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 4) AS value FROM p GROUP BY col""")
def js(spark, folder):
    return rounded(marginal.jensen_shannon(marginal.binned_counts(*lines(spark, folder), ALL)), "value")


@query("m7_chi_squared_statistic", f"""{BINS} SELECT col AS "column", round(sum((s - ps * ns) * (s - ps * ns) / (ps * ns)), 3) AS statistic, count(*) - 1 AS dof FROM p GROUP BY col""")
def chi(spark, folder):
    return rounded(marginal.chi_squared_statistic(marginal.binned_counts(*lines(spark, folder), ALL)), "statistic", digits=3)


# upper tail by Simpson's rule over the density on [0, statistic]
@query("m7_chi_squared_p_value", f"""{BINS}, st AS (SELECT col, sum((s - ps * ns) * (s - ps * ns) / (ps * ns)) AS x, CAST(count(*) - 1 AS DOUBLE) AS k FROM p GROUP BY col),
d AS (SELECT col, x, i, CASE WHEN i = 0 AND k = 2 THEN 0.5 WHEN i = 0 THEN 0.0 ELSE exp((k / 2 - 1) * ln(x * i / 4000.0::DOUBLE) - x * i / 8000.0::DOUBLE - k / 2 * ln(2.0::DOUBLE) - lgamma(k / 2)) END AS f
  FROM st, range(0, 4001) t(i))
SELECT col AS "column", round(greatest(1 - sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * f) * any_value(x) / 12000.0::DOUBLE, 0), 4) AS p_value FROM d GROUP BY col""")
def chi_p(spark, folder):
    out = marginal.chi_squared_p(marginal.chi_squared_statistic(marginal.binned_counts(*lines(spark, folder), ALL)))
    return rounded(out.select("column", "p_value"), "p_value")


@query("m8_feature_correlation", "SELECT round(avg(abs(a - b)), 6) AS value FROM (" + " UNION ALL ".join(
    f"SELECT corr({a}, {b}) FILTER (WHERE l_linestatus = 'O') AS a, corr({a}, {b}) FILTER (WHERE l_linestatus = 'F') AS b FROM lineitem"
    for i, a in enumerate(NUM) for b in NUM[i + 1:]) + ")")
def corr_gap(spark, folder):
    return rounded(marginal.feature_correlation_gap(*lines(spark, folder), NUM), "value", digits=6)


@query("m9_inverse_kl", f"""{BINS} SELECT col AS "column", round(1 / (1 + greatest(sum(ps * ln(ps / qs)), 0)), 6) AS value FROM p GROUP BY col""")
def kl(spark, folder):
    return rounded(marginal.inverse_kl(marginal.binned_counts(*lines(spark, folder), ALL)), "value", digits=6)


def _ecdf(c):
    return f"""SELECT '{c}' AS col, v, nxt, abs(cr / sum_r - cs / sum_s) AS gap FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, sum(r) OVER (ORDER BY v) AS cr,
      sum(s) OVER (ORDER BY v) AS cs, sum(r) OVER () AS sum_r, sum(s) OVER () AS sum_s FROM (SELECT {c} AS v, count(*) FILTER (WHERE l_linestatus = 'O') AS r,
      count(*) FILTER (WHERE l_linestatus = 'F') AS s FROM lineitem GROUP BY 1))"""


ECDF = "WITH e AS MATERIALIZED (" + " UNION ALL ".join(_ecdf(c) for c in NUM) + ")"


@query("m10_ks_complement", f'{ECDF} SELECT col AS "column", round(1 - max(gap), 6) AS value FROM e GROUP BY col')
def ks(spark, folder):
    return rounded(marginal.ks_complement(*lines(spark, folder), NUM), "value", digits=6)


@query("m11_mmd_rbf", f"""WITH {CUST_U}, k AS (
  SELECT (SELECT avg(exp(-power({distance_sql(2)}, 2))) FROM re a, re b) AS rr, (SELECT avg(exp(-power({distance_sql(2)}, 2))) FROM sy a, sy b) AS ss,
         (SELECT avg(exp(-power({distance_sql(2)}, 2))) FROM re a, sy b) AS rs)
SELECT round(rr + ss - 2 * rs, 6) AS value FROM k""")
def mmd(spark, folder):
    return rounded(proximity.mmd_rbf(scaled(spark, folder)), "value", digits=6)


@query("m11_mmd_linear", "SELECT round(" + " + ".join(
    f"power(avg({c}) FILTER (WHERE l_linestatus = 'O') - avg({c}) FILTER (WHERE l_linestatus = 'F'), 2)" for c in NUM) + ", 3) AS value FROM lineitem")
def mmd_line(spark, folder):
    return rounded(proximity.mmd_linear(*lines(spark, folder), NUM), "value", digits=3)


@query("m12_wasserstein_columns", f'{ECDF} SELECT col AS "column", round(sum(gap * (coalesce(nxt, v) - v)), 4) AS value FROM e GROUP BY col')
def wasserstein(spark, folder):
    return rounded(marginal.wasserstein_columns(*lines(spark, folder), NUM), "value")


SLICES = 4


def _sliced_sql() -> str:
    unit = marginal.slice_directions(SLICES, len(NUM))
    views = ", ".join(" + ".join(f"{c} * ({float(u)!r}::DOUBLE)" for c, u in zip(NUM, unit[k])) + f" AS slice_{k}" for k in range(SLICES))
    curves = " UNION ALL ".join(_ecdf(f"slice_{k}").replace("FROM lineitem", "FROM pj") for k in range(SLICES))
    return f"""WITH pj AS MATERIALIZED (SELECT l_linestatus, {views} FROM lineitem), e AS MATERIALIZED ({curves})
    SELECT col AS "column", round(sum(gap * (coalesce(nxt, v) - v)), 3) AS value FROM e GROUP BY col"""


@query("m12_wasserstein_sliced", _sliced_sql())
def sliced(spark, folder):
    return rounded(marginal.wasserstein_sliced(*lines(spark, folder), NUM, projections=SLICES), "value", digits=3)


PRDC = f"""{RS},
kr AS MATERIALIZED (SELECT id, d FROM (SELECT a.id, {distance_sql(2)} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {distance_sql(2)}) AS k FROM re a JOIN re b ON a.id <> b.id) WHERE k = 5),
ks AS MATERIALIZED (SELECT id, d FROM (SELECT a.id, {distance_sql(2)} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {distance_sql(2)}) AS k FROM sy a JOIN sy b ON a.id <> b.id) WHERE k = 5),
inr AS MATERIALIZED (SELECT b.id, count(*) FILTER (WHERE {distance_sql(2)} < kr.d) AS n FROM sy b, re a JOIN kr ON kr.id = a.id GROUP BY b.id),
ins AS MATERIALIZED (SELECT a.id, count(*) FILTER (WHERE {distance_sql(2)} < ks.d) AS n FROM re a, sy b JOIN ks ON ks.id = b.id GROUP BY a.id)"""


@query("m13_m16_prdc", f"""{PRDC} SELECT 'precision' AS metric, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS value FROM inr
UNION ALL SELECT 'recall', round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) FROM ins UNION ALL SELECT 'density', round(avg(n) / 5.0, 6) FROM inr
UNION ALL SELECT 'coverage', round(avg(CASE WHEN rs.d < kr.d THEN 1.0 ELSE 0.0 END), 6) FROM rs JOIN kr USING (id)""")
def prdc(spark, folder):
    return rounded(proximity.prdc(scaled(spark, folder)), "value", digits=6)


ALPHA = f"""{RS}, g AS (SELECT k, k / 29.0::DOUBLE AS al FROM range(0, 30) t(k)),
cr AS (SELECT avg(z0) AS c0, avg(z1) AS c1 FROM re), cs AS (SELECT avg(z0) AS c0, avg(z1) AS c1 FROM sy),
dr AS MATERIALIZED (SELECT sqrt((z0 - c0) * (z0 - c0) + (z1 - c1) * (z1 - c1)) AS d FROM re, cr),
ds AS MATERIALIZED (SELECT sqrt((z0 - c0) * (z0 - c0) + (z1 - c1) * (z1 - c1)) AS d FROM sy, cr),
dd AS MATERIALIZED (SELECT id, sqrt((z0 - c0) * (z0 - c0) + (z1 - c1) * (z1 - c1)) AS d FROM sy, cs),
ql AS (SELECT unnest(quantile_cont(d, (SELECT list(al ORDER BY k) FROM g))) AS r, unnest(range(0, 30)) AS k FROM dr),
pa AS (SELECT k, avg(CASE WHEN ds.d <= ql.r THEN 1.0 ELSE 0.0 END) AS p FROM ql, ds GROUP BY k),
nr AS MATERIALIZED (SELECT rs.d AS drs, rr.d AS drr, dd.d AS dc FROM rs JOIN rr ON rs.id = rr.id JOIN dd ON dd.id = rs.nid),
qb AS (SELECT unnest(quantile_cont(dc, (SELECT list(al ORDER BY k) FROM g))) AS r, unnest(range(0, 30)) AS k FROM nr),
pb AS (SELECT k, avg(CASE WHEN drs <= drr AND dc <= r THEN 1.0 ELSE 0.0 END) AS p FROM qb, nr GROUP BY k)"""
ALPHA = ALPHA.replace("quantile_cont(d, (SELECT list(al ORDER BY k) FROM g))", "quantile_cont(d, {A})").replace(
    "quantile_cont(dc, (SELECT list(al ORDER BY k) FROM g))", "quantile_cont(dc, {A})").replace("{A}", "[" + ", ".join(repr(i / 29) + "::DOUBLE" for i in range(30)) + "]")


@query("m17_m19_alpha_precision", f"""{ALPHA} SELECT 'delta_precision_alpha_naive' AS metric, round(1 - 2 * avg(abs(al - p)), 4) AS value FROM pa JOIN g USING (k)
UNION ALL SELECT 'delta_coverage_beta_naive', round(1 - 2 * avg(abs(al - p)), 4) FROM pb JOIN g USING (k)
UNION ALL SELECT 'authenticity_naive', round(avg(CASE WHEN sr.d > rr.d THEN 1.0 ELSE 0.0 END), 4) FROM sr JOIN rr ON rr.id = sr.nid""")
def alpha(spark, folder):
    return rounded(proximity.alpha_precision(scaled(spark, folder)), "value")


@query("m20_survival_distance", """
WITH a AS (SELECT CAST(l_quantity * 4 AS INTEGER) + l_linenumber AS t, l_linestatus AS st, CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS e FROM lineitem),
u AS (SELECT t, count(*) FILTER (WHERE st = 'O') AS nr, coalesce(sum(e) FILTER (WHERE st = 'O'), 0) AS dr, count(*) FILTER (WHERE st = 'F') AS ns,
      coalesce(sum(e) FILTER (WHERE st = 'F'), 0) AS ds FROM a GROUP BY t),
k AS (SELECT *, sum(nr) OVER (ORDER BY t DESC) AS rr, sum(ns) OVER (ORDER BY t DESC) AS rs, lead(t) OVER (ORDER BY t) AS nxt FROM u),
c AS (SELECT t, nxt, product(CASE WHEN rr > 0 THEN 1 - dr / rr ELSE 1 END) OVER (ORDER BY t) AS sr, product(CASE WHEN rs > 0 THEN 1 - ds / rs ELSE 1 END) OVER (ORDER BY t) AS ss FROM k)
SELECT round(sum(abs(sr - ss) * (coalesce(nxt, t) - t)) / sum(coalesce(nxt, t) - t), 6) AS value FROM c""")
def survival(spark, folder):
    t = table(spark, folder, "lineitem").select((F.col("l_quantity") * 4).cast("int").alias("q"), "l_linenumber", "l_linestatus",
                                                (F.col("l_returnflag") != "N").cast("int").alias("event"))
    t = t.withColumn("time", F.col("q") + F.col("l_linenumber"))
    return rounded(marginal.survival_distance(t.where("l_linestatus = 'O'"), t.where("l_linestatus = 'F'"), "time", "event"), "value", digits=6)


QI = ["c_nationkey", "c_mktsegment"]
BOOT = f"WITH bs AS MATERIALIZED ({BOOT_SQL}), r AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM bs GROUP BY 1, 2)"


def customers(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("m21_delta_presence", f"{BOOT} SELECT round(max(coalesce(r.n, 0) / (coalesce(s.n, 0) + 1e-8::DOUBLE)), 4) AS value FROM r FULL JOIN s USING (c_nationkey, c_mktsegment)")
def presence(spark, folder):
    return rounded(privacy.delta_presence(customers(spark, folder), bootstrapped_customers(spark, folder), QI), "value")


@query("m22_k_anonymity", f"{BOOT} SELECT 'gt' AS side, round(min(n), 8) AS value FROM r UNION ALL SELECT 'syn', round(min(n) + 1e-8::DOUBLE, 8) FROM s")
def anonymity(spark, folder):
    gt = privacy.k_anonymity(customers(spark, folder), QI).withColumn("side", F.lit("gt"))
    syn = privacy.k_anonymity(bootstrapped_customers(spark, folder), QI, True).withColumn("side", F.lit("syn"))
    return rounded(gt.unionByName(syn), "value", digits=8)


@query("m23_k_map", f"{BOOT} SELECT CAST(min(s.n) AS DOUBLE) AS value FROM r JOIN s USING (c_nationkey, c_mktsegment)")
def kmap(spark, folder):
    return privacy.k_map(customers(spark, folder), bootstrapped_customers(spark, folder), QI)


@query("m24_l_diversity", f"""{BOOT} SELECT 'gt' AS side, CAST(min(n) AS DOUBLE) AS value FROM (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1)
UNION ALL SELECT 'syn', round(min(n) + 1e-8::DOUBLE, 8) FROM (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM bs GROUP BY 1)""")
def diversity(spark, folder):
    gt = privacy.l_diversity(customers(spark, folder), ["c_nationkey"], ["c_mktsegment"]).withColumn("side", F.lit("gt"))
    syn = privacy.l_diversity(bootstrapped_customers(spark, folder), ["c_nationkey"], ["c_mktsegment"], True).withColumn("side", F.lit("syn"))
    return rounded(gt.unionByName(syn), "value", digits=8)


@query("m22_k_anonymity_kmeans")
def anonymity_cells(spark, folder):
    real, syn = customer_supplier(spark, folder)
    r, s, groups = privacy.assign_groups(real, syn, PAIR_COLUMNS, "kmeans", k=10)
    return privacy.group_counts(r, s, groups)


@query("m25_identifiability", """
WITH h AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1)),
g AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS g FROM (SELECT c_acctbal, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1)),
re AS MATERIALIZED (SELECT c_custkey AS id, c_nationkey / h.h AS z0, c_acctbal / g.g AS z1 FROM customer, h, g),
sy AS MATERIALIZED (SELECT s_suppkey AS id, s_nationkey / h.h AS z0, s_acctbal / g.g AS z1 FROM supplier, h, g),""" + f"""
rs AS (SELECT a.id, min({distance_sql(2)}) AS d FROM re a, sy b GROUP BY a.id), rr AS (SELECT a.id, min({distance_sql(2)}) AS d FROM re a JOIN re b ON a.id <> b.id GROUP BY a.id)
SELECT round(avg(CASE WHEN rs.d < rr.d THEN 1.0 ELSE 0.0 END), 6) AS value FROM rs JOIN rr USING (id)""")
def identifiability(spark, folder):
    real, syn = customer_supplier(spark, folder)
    return rounded(proximity.identifiability(real, syn, "c_custkey", "c_custkey", PAIR_COLUMNS), "value", digits=6)


def model_tables(spark, folder):
    """Real = open lines, synthetic = finished lines, target = return flag code."""
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    t = table(spark, folder, "lineitem").select(F.xxhash64("*").alias("id"), "l_linestatus", *NUM, code.alias("flag"),
                                                (F.col("l_extendedprice") / 1000).alias("price"))
    return t.where("l_linestatus = 'O'").drop("l_linestatus"), t.where("l_linestatus = 'F'").drop("l_linestatus")


@query("m26_m28_train_on_synthetic")
def performance(spark, folder):
    real, syn = model_tables(spark, folder)
    return rounded(utility.train_on_synthetic(real, syn, NUM, "flag", "id"), "value")


@query("m26_m28_train_on_synthetic_regression")
def performance_reg(spark, folder):
    real, syn = model_tables(spark, folder)
    return rounded(utility.train_on_synthetic(real, syn, ["l_quantity", "l_discount", "l_tax"], "price", "id", "regression"), "value")


@query("m29_feature_rank_distance")
def importance(spark, folder):
    real, syn = model_tables(spark, folder)
    return rounded(utility.feature_rank_distance(real, syn, ["l_quantity", "l_discount", "l_tax", "flag"], "price"), "value")


@query("m30_detection")
def detect(spark, folder):
    real, syn = customer_supplier(spark, folder)
    return rounded(utility.detection(scale.standardise(real, PAIR_COLUMNS), scale.standardise(syn, PAIR_COLUMNS),
                                     [f"z_{c}" for c in PAIR_COLUMNS], "c_custkey", "c_custkey"), "value")


SPEC = TableSpec(row_id="c_custkey", target="region", features=tuple(PAIR_COLUMNS), quasi_identifiers=("c_nationkey",), sensitive=("c_acctbal",))


def with_region(spark, folder, *frames):
    """The region code of the nation as the label of the model metrics, 0..n-1."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    return [df.join(F.broadcast(nation), "c_nationkey") for df in frames]


@query("m31_metric_suite")
def suite(spark, folder):
    real, syn = with_region(spark, folder, *customer_supplier(spark, folder))
    return rounded(evaluate(real, syn, SPEC, list(FAMILIES)), "min", "max", "mean", "stddev", "median", "iqr").drop("error")


@query("m31_two_arm_comparison")
def arms(spark, folder):
    base, = with_region(spark, folder, table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    kept = base.where(F.col("c_acctbal") <= 9000)

    def generate(src):
        return bootstrap(src, "c_custkey", src.count()).drop("c_custkey").withColumnRenamed("gen_id", "c_custkey")

    _, winners = two_arms(base, kept, generate, SPEC, list(FAMILIES))
    return rounded(winners, "orig", "sanitised")
