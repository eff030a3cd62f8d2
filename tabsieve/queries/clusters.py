"""Clustering, centres, trimming and configuration search on the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import encode, filters, neighbours, scale, search
from tabsieve.operators.centre import centre_distances, geometric_medians
from tabsieve.operators.compare import tagged_union
from tabsieve.operators.dbscan import dbscan
from tabsieve.operators.diagnose import cluster_summary, grid_extremes, silhouette_squared
from tabsieve.plans.sanitiser import capped_sanitiser, label_and_measure, threshold_sanitiser, trimmed_strata
from tabsieve.queries.registry import dbscan_ctes, distance_sql, query, rounded, table, z_sql
from tabsieve.session import broadcast_if, materialise
from tabsieve.spec import TableSpec

FEATURES = ["p_size", "p_retailprice"]
ZPART = z_sql("part", "p_partkey", FEATURES)
EPS, MIN_SAMPLES = 0.1, 4
LAB = f"WITH RECURSIVE pz AS MATERIALIZED ({ZPART}), {dbscan_ctes('', 'pz', 2, EPS, MIN_SAMPLES)}"
ROWS = f"""{LAB}, rows AS MATERIALIZED (SELECT l.id, l.cluster, p.p_type, CAST(p.p_size AS DOUBLE) AS z0, p.p_retailprice AS z1
  FROM lab l JOIN part p ON p.p_partkey = l.id)"""


def part_z(spark, folder):
    return scale.standardise(table(spark, folder, "part").select("p_partkey", "p_type", *FEATURES), FEATURES)


def labelled(spark, folder, eps=EPS, min_samples=MIN_SAMPLES, metric="euclidean"):
    return dbscan(part_z(spark, folder), "p_partkey", [f"z_{c}" for c in FEATURES], [(eps, min_samples)], metric)


@query("d1_dbscan_labels", f"{LAB} SELECT id AS p_partkey, cluster FROM lab")
def labels(spark, folder):
    return labelled(spark, folder).select("p_partkey", "cluster")


@query("d1_dbscan_manhattan", f"""WITH RECURSIVE pz AS MATERIALIZED ({ZPART}), {dbscan_ctes('', 'pz', 2, 0.12, 5, 'manhattan')}
SELECT id AS p_partkey, cluster FROM lab""")
def labels_l1(spark, folder):
    return labelled(spark, folder, 0.12, 5, "manhattan").select("p_partkey", "cluster")


@query("d1_dbscan_customer_balance", f"""
WITH RECURSIVE pz AS MATERIALIZED ({z_sql('customer', 'c_custkey', ['c_acctbal'])}), {dbscan_ctes('', 'pz', 1, 0.01, 4)}
SELECT id AS c_custkey, cluster FROM lab""")
def labels_balance(spark, folder):
    c = scale.standardise(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return dbscan(c, "c_custkey", ["z_c_acctbal"], [(0.01, 4)]).select("c_custkey", "cluster")


@query("a1_cluster_summary", f"""{LAB}
SELECT count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS num_clusters, count(*) FILTER (WHERE cluster < 0) AS n_noise, count(*) AS n_rows,
       round(count(*) FILTER (WHERE cluster < 0) / count(*), 6) AS noise_share FROM lab""")
def summary(spark, folder):
    return rounded(cluster_summary(labelled(spark, folder)), "noise_share", digits=6)


@query("w3_cluster_numbers", f"""{LAB}
SELECT cluster, min(id) AS first_row, count(*) AS n FROM lab WHERE cluster >= 0 AND id IN (SELECT id FROM core) GROUP BY cluster""")
def numbering(spark, folder):
    z = part_z(spark, folder)
    deg = neighbours.eps_neighbour_counts(z, "p_partkey", [f"z_{c}" for c in FEATURES], EPS)
    core = labelled(spark, folder).join(deg.where(F.col("n_neighbours") >= MIN_SAMPLES), "p_partkey")
    return core.groupBy("cluster").agg(F.min("p_partkey").alias("first_row"), F.count(F.lit(1)).alias("n"))


@query("f1_noise_split", f"""{LAB} SELECT id AS p_partkey, CASE WHEN cluster >= 0 THEN cluster END AS cluster, cluster < 0 AS is_outlier FROM lab""")
def noise_split(spark, folder):
    kept, noise = filters.split_noise(labelled(spark, folder).select("p_partkey", "cluster"))
    return tagged_union(kept, noise)


def medians_sql(steps: int, variant: str, source: str = "rows", where: str = "cluster >= 0", p: str = "") -> str:
    """CTEs c0 … c<steps>: the start (means) and each Weiszfeld step per cluster."""
    out = [f"{p}mem AS MATERIALIZED (SELECT * FROM {source} WHERE {where})",
           f"{p}c0 AS MATERIALIZED (SELECT cluster, avg(z0) AS z0, avg(z1) AS z1 FROM {p}mem GROUP BY cluster)"]
    for k in range(1, steps + 1):
        d = distance_sql(2, a="m", b="c")
        inv = f"CASE WHEN {d} > 0 THEN 1.0 / {d} ELSE 0.0 END"
        out.append(f"{p}t{k} AS MATERIALIZED (SELECT m.cluster, sum(m.z0 * ({inv})) / sum({inv}) AS z0, sum(m.z1 * ({inv})) / sum({inv}) AS z1, "
                   f"sum({inv}) AS s, count(*) FILTER (WHERE {d} = 0) AS zeros, any_value(c.z0) AS o0, any_value(c.z1) AS o1 "
                   f"FROM {p}mem m JOIN {p}c{k - 1} c ON m.cluster = c.cluster GROUP BY m.cluster)")
        if variant == "plain":
            out.append(f"{p}c{k} AS MATERIALIZED (SELECT cluster, coalesce(z0, o0) AS z0, coalesce(z1, o1) AS z1 FROM {p}t{k})")
        else:
            r = "sqrt(((z0 - o0) * s) * ((z0 - o0) * s) + ((z1 - o1) * s) * ((z1 - o1) * s))"
            ratio = f"CASE WHEN zeros = 0 OR {r} = 0 THEN 0.0 ELSE zeros / {r} END"
            out.append(f"{p}c{k} AS MATERIALIZED (SELECT cluster, greatest(0, 1 - ({ratio})) * z0 + least(1, {ratio}) * o0 AS z0, "
                       f"greatest(0, 1 - ({ratio})) * z1 + least(1, {ratio}) * o1 AS z1 FROM {p}t{k})")
    return ",\n".join(out)


def converged_sql(variant: str, source: str = "rows", where: str = "cluster >= 0") -> str:
    """CTEs ``mem`` and ``centre``: Weiszfeld steps per cluster until one is shorter than 1e-5, 400 at most."""
    d = distance_sql(2, a="m", b="i")
    inv = f"CASE WHEN {d} > 0 THEN 1.0 / {d} ELSE 0.0 END"
    if variant == "plain":
        n0, n1 = "coalesce(t0, o0)", "coalesce(t1, o1)"
    else:
        r = "sqrt(((t0 - o0) * s) * ((t0 - o0) * s) + ((t1 - o1) * s) * ((t1 - o1) * s))"
        ratio = f"CASE WHEN zeros = 0 THEN 0.0 WHEN s = 0 OR {r} = 0 THEN 1.0 ELSE least(1.0, zeros / {r}) END"
        n0, n1 = (f"coalesce(o{i} + (1.0 - ({ratio})) * (t{i} - o{i}), o{i})" for i in (0, 1))
    return f"""mem AS MATERIALIZED (SELECT * FROM {source} WHERE {where}),
it AS (SELECT 0 AS k, cluster, avg(z0) AS z0, avg(z1) AS z1, 1e9 AS moved FROM mem GROUP BY cluster
  UNION ALL
  SELECT k + 1, cluster, n0, n1, sqrt((n0 - o0) * (n0 - o0) + (n1 - o1) * (n1 - o1)) FROM (
    SELECT k, cluster, o0, o1, {n0} AS n0, {n1} AS n1 FROM (
      SELECT i.k, m.cluster, i.z0 AS o0, i.z1 AS o1, sum(m.z0 * ({inv})) / nullif(sum({inv}), 0) AS t0, sum(m.z1 * ({inv})) / nullif(sum({inv}), 0) AS t1,
             sum({inv}) AS s, count(*) FILTER (WHERE {d} = 0) AS zeros
      FROM mem m JOIN it i ON m.cluster = i.cluster WHERE i.moved >= 1e-5 AND i.k < 400 GROUP BY i.k, m.cluster, i.z0, i.z1))),
centre AS MATERIALIZED (SELECT cluster, arg_max(z0, k) AS z0, arg_max(z1, k) AS z1 FROM it GROUP BY cluster)"""


@query("a10_geometric_median_plain", f"""{ROWS}, {converged_sql('plain')}
SELECT cluster, round(z0, 4) AS m_p_size, round(z1, 4) AS m_p_retailprice FROM centre""")
def median_plain(spark, folder):
    rows = labelled(spark, folder).where("cluster >= 0")
    return rounded(geometric_medians(rows, FEATURES), "m_p_size", "m_p_retailprice")


@query("a11_geometric_median_vardi_zhang", f"""WITH RECURSIVE rows AS MATERIALIZED (
  SELECT c_nationkey AS cluster, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS z0, CAST(length(c_mktsegment) AS DOUBLE) AS z1 FROM customer),
{converged_sql('vardi_zhang', where='true')}
SELECT cluster, round(z0, 4) AS m_balance, round(z1, 4) AS m_name FROM centre""")
def median_vz(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("cluster"), F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("balance"),
        F.length("c_mktsegment").cast("double").alias("name"))
    out = geometric_medians(rows, ["balance", "name"], variant="vardi_zhang")
    return rounded(out, "m_balance", "m_name")


DIST = f"""{ROWS}, {medians_sql(60, 'plain')}, dist AS MATERIALIZED (
  SELECT m.id, m.cluster, m.p_type, sqrt(0.75 * (m.z0 - c.z0) * (m.z0 - c.z0) + 0.25 * (m.z1 - c.z1) * (m.z1 - c.z1)) AS d
  FROM mem m JOIN c60 c ON m.cluster = c.cluster)"""


@query("a12_weighted_distance", f"{DIST} SELECT id AS p_partkey, cluster, round(d, 3) AS distance FROM dist")
def weighted(spark, folder):
    rows = labelled(spark, folder).where("cluster >= 0").select("p_partkey", "cluster", *FEATURES)
    centres = geometric_medians(rows, FEATURES, tol=0.0, max_iter=60)
    out = centre_distances(rows, centres, FEATURES, weights={"p_size": 3.0})
    return rounded(out.select("p_partkey", "cluster", "distance"), "distance", digits=3)


@query("j7_centre_join", f"""{ROWS}, {converged_sql('plain')}
SELECT m.id AS p_partkey, m.cluster, round(m.z0 - c.z0, 4) AS off_size, round(m.z1 - c.z1, 4) AS off_price FROM mem m JOIN centre c ON m.cluster = c.cluster""")
def centre_join(spark, folder):
    rows = materialise(labelled(spark, folder).where("cluster >= 0"))
    centres = materialise(geometric_medians(rows, FEATURES))
    out = rows.join(broadcast_if(centres, 32 * centres.count()), "cluster").select(
        "p_partkey", "cluster", (F.col("p_size") - F.col("m_p_size")).alias("off_size"), (F.col("p_retailprice") - F.col("m_p_retailprice")).alias("off_price"))
    return rounded(out, "off_size", "off_price")


@query("a9_silhouette", f"""{LAB}, n AS (SELECT cluster, count(*) AS n FROM lab GROUP BY cluster),
pl AS MATERIALIZED (SELECT p.id, p.z0, p.z1, l.cluster FROM pz p JOIN lab l ON p.id = l.id),
s AS MATERIALIZED (SELECT a.id, a.cluster AS own, b.cluster AS oth, sum({distance_sql(2)}) AS s FROM pl a, pl b GROUP BY 1, 2, 3),
i AS (SELECT s.id, s.own, max(CASE WHEN own = oth THEN s / greatest(n.n - 1, 1) END) AS a, min(CASE WHEN own <> oth THEN s / n.n END) AS b,
             max(CASE WHEN own = oth THEN n.n END) AS n_own FROM s JOIN n ON s.oth = n.cluster GROUP BY 1, 2)
SELECT round(avg(CASE WHEN n_own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM i""")
def silhouette(spark, folder):
    rows = materialise(labelled(spark, folder))
    return rounded(neighbours.silhouette(rows, "p_partkey", [f"z_{c}" for c in FEATURES]), "silhouette")


_SQ = distance_sql(2).replace("sqrt(", "(", 1)


@query("a9_silhouette_squared", f"""{LAB}, n AS (SELECT cluster, count(*) AS n FROM lab GROUP BY cluster),
pl AS MATERIALIZED (SELECT p.id, p.z0, p.z1, l.cluster FROM pz p JOIN lab l ON p.id = l.id),
s AS MATERIALIZED (SELECT a.id, a.cluster AS own, b.cluster AS oth, sum({_SQ}) AS s FROM pl a, pl b GROUP BY 1, 2, 3),
i AS (SELECT s.id, s.own, max(CASE WHEN own = oth THEN s / greatest(n.n - 1, 1) END) AS a, min(CASE WHEN own <> oth THEN s / n.n END) AS b,
             max(CASE WHEN own = oth THEN n.n END) AS n_own FROM s JOIN n ON s.oth = n.cluster GROUP BY 1, 2)
SELECT round(avg(CASE WHEN n_own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette_sq FROM i""")
def squared(spark, folder):
    rows = materialise(labelled(spark, folder))
    return rounded(spark.createDataFrame([(silhouette_squared(rows, [f"z_{c}" for c in FEATURES]),)], "silhouette_sq double"), "silhouette_sq")


@query("f3_stratified_trim", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice FROM lineitem
QUALIFY l_extendedprice <= quantile_cont(l_extendedprice, 0.9) OVER (PARTITION BY l_returnflag, l_linestatus)""")
def trim(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                                    F.col("l_extendedprice").alias("distance"))
    return filters.stratified_trim(lines, 0.10, ["l_returnflag", "l_linestatus"]).withColumnRenamed("distance", "l_extendedprice")


TH = "(SELECT c_nationkey AS cluster, avg(c_acctbal) AS threshold FROM customer WHERE c_nationkey % 4 <> 1 GROUP BY 1)"


def customer_thresholds(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("cluster"), F.col("c_acctbal").alias("distance"))
    th = c.where(F.col("cluster") % 4 != 1).groupBy("cluster").agg(F.avg("distance").alias("threshold"))
    return c, th


@query("f2_threshold_split", f"""
SELECT c_custkey, CASE WHEN c_acctbal <= threshold THEN c_nationkey END AS cluster, CASE WHEN c_acctbal <= threshold THEN c_acctbal END AS distance,
       c_acctbal > threshold AS is_outlier FROM customer JOIN {TH} t ON c_nationkey = t.cluster""")
def threshold(spark, folder):
    return tagged_union(*filters.threshold_split(*customer_thresholds(spark, folder)))


@query("j8_threshold_join_keep_missing", f"""
SELECT c_custkey, c_nationkey AS cluster, c_acctbal AS distance FROM customer LEFT JOIN {TH} t ON c_nationkey = t.cluster
WHERE threshold IS NULL OR c_acctbal <= threshold""")
def threshold_keep(spark, folder):
    return filters.threshold_split(*customer_thresholds(spark, folder), on_missing="keep")[0]


FLAGSHIP = f"""{ROWS}, {medians_sql(60, 'plain')},
dist AS MATERIALIZED (SELECT m.id, m.cluster, m.p_type, sqrt(0.5 * (m.z0 - c.z0) * (m.z0 - c.z0) + 0.5 * (m.z1 - c.z1) * (m.z1 - c.z1)) AS d
  FROM mem m JOIN c60 c ON m.cluster = c.cluster),
kept AS MATERIALIZED (SELECT id, cluster, p_type FROM dist QUALIFY d <= quantile_cont(d, 0.9) OVER (PARTITION BY cluster, p_type))"""


@query("flagship_trimmed_strata", f"""{FLAGSHIP}
SELECT r.cluster, r.p_type, count(*) AS n_rows, count(k.id) AS kept, count(*) - count(k.id) AS removed FROM rows r LEFT JOIN kept k ON r.id = k.id
GROUP BY 1, 2""")
def flagship(spark, folder):
    return trimmed_strata(table(spark, folder, "part"), "p_partkey", FEATURES, "p_type", EPS, MIN_SAMPLES)


# The search runs over part sizes and coded part types, which separate into one cluster per type.
GRID = [(e, m) for e in (0.1, 0.2) for m in (10, 30)]
ENC = "(SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS p_type, CAST(p_size AS DOUBLE) AS p_size FROM part)"
ZENC = z_sql(ENC, "p_partkey", ["p_type", "p_size"])


def _grid_sql(metric: str, configs):
    ctes, tails = [], []
    for i, (e, m) in enumerate(configs):
        p = f"{metric[:3]}{i}_"
        # pw holds the same rows whitened, so that its Euclidean distance is the Mahalanobis one
        plain, source = ("euclidean", "pw") if metric == "mahalanobis" else (metric, "pz")
        ctes.append(dbscan_ctes(p, source, 2, e, m, plain))
        ctes.append(f"""{p}n AS (SELECT cluster, count(*) AS n FROM {p}lab GROUP BY cluster),
        {p}pl AS MATERIALIZED (SELECT p.id, p.z0, p.z1, l.cluster FROM pz p JOIN {p}lab l ON p.id = l.id),
        {p}s AS MATERIALIZED (SELECT a.id, a.cluster AS own, b.cluster AS oth, sum({distance_sql(2)}) AS s FROM {p}pl a, {p}pl b GROUP BY 1, 2, 3),
        {p}i AS (SELECT s.id, s.own, max(CASE WHEN own = oth THEN s / greatest(n.n - 1, 1) END) AS a, min(CASE WHEN own <> oth THEN s / n.n END) AS b,
                 max(CASE WHEN own = oth THEN n.n END) AS n_own FROM {p}s s JOIN {p}n n ON s.oth = n.cluster GROUP BY 1, 2),
        {p}sil AS (SELECT CASE WHEN (SELECT count(*) FROM {p}n) < 2 THEN -1.0 ELSE avg(CASE WHEN n_own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) END AS sil FROM {p}i)""")
        tails.append(f"SELECT '{metric}' AS metric, {e!r}::DOUBLE AS eps, {m} AS min_samples, "
                     f"(SELECT count(DISTINCT cluster) FROM {p}lab WHERE cluster >= 0) AS num_clusters, "
                     f"(SELECT avg(CASE WHEN cluster < 0 THEN 1.0 ELSE 0.0 END) FROM {p}lab) AS percentage_outliers, (SELECT sil FROM {p}sil) AS silhouette_score")
    return ",\n".join(ctes), "\nUNION ALL ".join(tails)


_GC, _GT = _grid_sql("euclidean", GRID)
GRID_CTE = f"WITH RECURSIVE pz AS MATERIALIZED ({ZENC}), {_GC}, grid AS MATERIALIZED ({_GT})"


def part_grid(spark, folder, metrics=("euclidean",), **inert):
    p = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    coded = encode.ordinal_encode(p, encode.category_mapping(p))
    return search.grid_search(coded, "p_partkey", ["p_type", "p_size"], (0.1, 0.2), (10, 30), metrics, **inert)


@query("d2_grid_search", f"""{GRID_CTE}
SELECT metric, eps, min_samples, num_clusters, round(percentage_outliers, 4) AS percentage_outliers, round(silhouette_score, 4) AS silhouette_score,
       a.algorithm, l.leaf_size, CAST(NULL AS INTEGER) AS p
FROM grid, (SELECT unnest(['auto', 'brute']) AS algorithm) a, (SELECT unnest([10, 20]) AS leaf_size) l""")
def grid_table(spark, folder):
    out = part_grid(spark, folder, algorithms=("auto", "brute"), leaf_sizes=(10, 20))
    return rounded(out.withColumn("p", F.col("p").cast("int")), "percentage_outliers", "silhouette_score")


_MC, _MT = _grid_sql("manhattan", GRID)
_HC, _HT = _grid_sql("mahalanobis", GRID)


@query("d2_grid_search_other_metrics", f"""WITH RECURSIVE pz AS MATERIALIZED ({ZENC}),
pc AS (SELECT var_pop(z0) AS a, covar_pop(z0, z1) AS b, var_pop(z1) AS d FROM pz),
pw AS MATERIALIZED (SELECT id, z0 / sqrt(a) AS z0, (z1 - b / a * z0) / sqrt(d - b * b / a) AS z1 FROM pz, pc), {_MC}, {_HC},
grid AS ({_MT} UNION ALL {_HT})
SELECT metric, eps, min_samples, num_clusters, round(percentage_outliers, 4) AS percentage_outliers, round(silhouette_score, 4) AS silhouette_score,
       'auto' AS algorithm, 30 AS leaf_size FROM grid""")
def grid_metrics(spark, folder):
    out = part_grid(spark, folder, ("manhattan", "mahalanobis"))
    return rounded(out.drop("p"), "percentage_outliers", "silhouette_score")


@query("d4_rank_configurations", f"""{GRID_CTE}
SELECT eps, min_samples, num_clusters, round(silhouette_score, 4) AS silhouette_score FROM grid WHERE silhouette_score >= 0
ORDER BY (abs(num_clusters - 5) + 1e-6) * (1 - silhouette_score) * abs(percentage_outliers - 0.05), eps, min_samples LIMIT 2""")
def ranked(spark, folder):
    out = search.rank_configurations(part_grid(spark, folder), 0.05, num_clusters=5, top_n=2)
    return rounded(out.select("eps", "min_samples", "num_clusters", "silhouette_score"), "silhouette_score")


@query("d5_rank_by_noise", f"""{GRID_CTE}
SELECT eps, min_samples, num_clusters FROM grid WHERE num_clusters = (SELECT num_clusters FROM grid ORDER BY abs(num_clusters - 7), num_clusters LIMIT 1)
ORDER BY abs(percentage_outliers - 0.05), eps, min_samples LIMIT 2""")
def ranked_old(spark, folder):
    return search.rank_by_noise(part_grid(spark, folder), 0.05, num_clusters=7, top_n=2).select("eps", "min_samples", "num_clusters")


@query("a17_grid_extremes", f"""{GRID_CTE}
SELECT round(greatest(max(silhouette_score), -1.0), 4) AS best_sil, round(least(min(percentage_outliers), 1.0), 4) AS min_noise FROM grid WHERE num_clusters >= 2""")
def extremes(spark, folder):
    grid = part_grid(spark, folder).select(F.col("num_clusters").alias("k"), F.col("silhouette_score").alias("sil"), F.col("percentage_outliers").alias("noise"))
    return rounded(grid_extremes(grid), "best_sil", "min_noise")


@query("o3_grid_order", f"""{GRID_CTE}
SELECT eps, min_samples, num_clusters, round(silhouette_score, 4) AS silhouette_score FROM grid WHERE silhouette_score >= -0.5
ORDER BY silhouette_score DESC, num_clusters DESC, percentage_outliers""")
def grid_order(spark, folder):
    out = search.order_grid(part_grid(spark, folder), -0.5)
    return rounded(out.select("eps", "min_samples", "num_clusters", "silhouette_score"), "silhouette_score")


@query("f6_admissible_configurations", """
SELECT p_brand, p_size, count(DISTINCT p_type) AS k, count(*) AS kept, max(p_retailprice) > 905 AS cap_ok FROM part GROUP BY 1, 2
HAVING count(DISTINCT p_type) >= 2 AND max(p_retailprice) > 905 AND count(*) >= 3""")
def admissible(spark, folder):
    grid = table(spark, folder, "part").groupBy("p_brand", "p_size").agg(
        F.count_distinct("p_type").alias("k"), F.count(F.lit(1)).alias("kept"), (F.max("p_retailprice") > 905).alias("cap_ok"))
    return filters.admissible(grid, min_kept=3)


@query("f7_closest_cluster_count", """
WITH g AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS num_clusters FROM lineitem GROUP BY 1)
SELECT * FROM g WHERE num_clusters = (SELECT num_clusters FROM g ORDER BY abs(num_clusters - 520), num_clusters LIMIT 1)""")
def closest(spark, folder):
    grid = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("num_clusters"))
    return filters.closest_cluster_count(grid, 520)


@query("f8_size_guard", """
SELECT c AS n_members, s AS n_holdout, CASE WHEN c >= 50 AND s >= 1000 THEN 'ok' ELSE 'too small' END AS status
FROM (SELECT count(*) AS c FROM customer), (SELECT count(*) AS s FROM supplier)""")
def guard(spark, folder):
    return filters.size_guard(table(spark, folder, "customer"), table(spark, folder, "supplier"), min_holdout=1000)


@query("d3_relative_grid", f"""
WITH s AS MATERIALIZED (SELECT * FROM ({ZPART}) ORDER BY md5('0|' || id), id LIMIT 1200),
m AS (SELECT median({distance_sql(2)}) AS unit FROM s a JOIN s b ON a.id < b.id)
SELECT f AS frac, round(f * unit, 4) AS eps FROM m, (SELECT unnest([0.05, 0.1, 0.15]::DOUBLE[]) AS f)""")
def relative(spark, folder):
    fractions = [0.05, 0.1, 0.15]
    eps = search.relative_eps(part_z(spark, folder), "p_partkey", [f"z_{c}" for c in FEATURES], fractions)
    return rounded(spark.createDataFrame(list(zip(fractions, eps)), "frac double, eps double"), "eps")


SPEC = TableSpec(row_id="p_partkey", target="p_type", features=tuple(FEATURES))


CAP_GRID = [(0.1, 4), (0.1, 8), (0.2, 8)]


def _capped_ctes(configs) -> str:
    """CTEs ending in ``search``, with the kept rows of configuration i in ``euc{i}_kept``."""
    grid, tails = _grid_sql("euclidean", configs)
    ctes = [grid]
    for i, (e, m) in enumerate(configs):
        p = f"euc{i}_"
        ctes.append(f"""{p}rows AS MATERIALIZED (SELECT l.id, l.cluster, p.p_type, CAST(p.p_size AS DOUBLE) AS z0, p.p_retailprice AS z1
          FROM {p}lab l JOIN part p ON p.p_partkey = l.id), {medians_sql(60, 'plain', f'{p}rows', p=p)},
        {p}d AS MATERIALIZED (SELECT m.id, m.cluster, m.p_type, sqrt(0.5 * (m.z0 - c.z0) * (m.z0 - c.z0) + 0.5 * (m.z1 - c.z1) * (m.z1 - c.z1)) AS d
          FROM {p}mem m JOIN {p}c60 c ON m.cluster = c.cluster),
        {p}kept AS MATERIALIZED (SELECT id, p_type FROM {p}d QUALIFY d <= quantile_cont(d, 0.9) OVER (PARTITION BY cluster, p_type)),
        {p}loss AS (SELECT sum(k) AS kept, 1 - sum(k) / sum(n) AS overall_loss, max(1 - k / n) AS worst FROM
          (SELECT r.p_type, count(*) AS n, count(k.id) AS k FROM {p}rows r LEFT JOIN {p}kept k ON r.id = k.id GROUP BY 1))""")
    lines = " UNION ALL ".join(f"SELECT {e!r}::DOUBLE AS eps, {m} AS min_samples, kept, overall_loss, worst - overall_loss AS excess FROM euc{i}_loss"
                               for i, (e, m) in enumerate(configs))
    return f"""WITH RECURSIVE pz AS MATERIALIZED ({ZPART}), {", ".join(ctes)}, grid AS ({tails}), l AS ({lines}),
    search AS MATERIALIZED (SELECT g.eps, g.min_samples AS mp, num_clusters AS k, percentage_outliers AS noise, silhouette_score AS sil, CAST(kept AS BIGINT) AS kept,
      overall_loss, excess AS worst_excess, excess <= 0.1 + 1e-9 AS cap_ok, (1 - greatest(silhouette_score, 0)) * abs(percentage_outliers - 0.1) AS score
    FROM grid g JOIN l ON g.eps = l.eps AND g.min_samples = l.min_samples WHERE num_clusters >= 2 AND kept >= 0.4 * (SELECT count(*) FROM part))"""


#: Eps values and minimum samples of the sanitiser query; some of the configurations meet the cap, some miss it.
CHOICE = ((0.1, 0.2), (4, 8))
CHOICE_GRID = [(e, m) for e in CHOICE[0] for m in CHOICE[1]]


@query("d6_capped_search", f"""{_capped_ctes(CAP_GRID)}
SELECT eps, mp, k, round(noise, 4) AS noise, round(sil, 4) AS sil, kept, round(overall_loss, 4) AS overall_loss, round(worst_excess, 4) AS worst_excess,
  cap_ok, round(score, 4) AS score FROM search""")
def capped(spark, folder):
    """Search table of the class-capped sanitiser over the part table."""
    p = table(spark, folder, "part").select("p_partkey", "p_type", *FEATURES)
    out, _ = search.capped_search(p, "p_partkey", FEATURES, "p_type", CAP_GRID, min_kept_share=0.4)
    return rounded(out.select("eps", "mp", "k", "noise", "sil", "kept", "overall_loss", "worst_excess", "cap_ok", "score"),
                   "noise", "sil", "overall_loss", "worst_excess", "score")


@query("d6_capped_sanitiser", f"""{_capped_ctes(CHOICE_GRID)},
best AS (SELECT eps, mp FROM search WHERE cap_ok ORDER BY score, eps, mp LIMIT 1),
kept AS ({" UNION ALL ".join(f"SELECT id, {e!r}::DOUBLE AS eps, {m} AS mp FROM euc{i}_kept" for i, (e, m) in enumerate(CHOICE_GRID))})
SELECT p.p_partkey, p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice FROM part p JOIN kept k ON p.p_partkey = k.id JOIN best b ON k.eps = b.eps AND k.mp = b.mp""")
def sanitised(spark, folder):
    """The kept rows of the best configuration that meets the cap, undecoded; none where no configuration is admissible."""
    part = table(spark, folder, "part")
    kept = capped_sanitiser(part, SPEC, eps_values=CHOICE[0], min_samples=CHOICE[1], impute=False).table
    return part.where(F.lit(False)) if kept is None else kept


@query("d2_default_grid")
def default_grid(spark, folder):
    """The operator's whole default grid: 70 configurations in three metrics. As SQL it would be 210 recursions; tests compare with brute force."""
    p = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    out = search.grid_search(encode.ordinal_encode(p, encode.category_mapping(p)), "p_partkey", ["p_type", "p_size"])
    return rounded(out.drop("p"), "percentage_outliers", "silhouette_score")


@query("d6_default_search")
def default_search(spark, folder):
    """Search table of the sanitiser over its default grid of 96 configurations; a golden table and brute force test it."""
    spec = TableSpec(row_id="p_partkey", target="p_brand", features=("p_type", "p_size"))
    out = capped_sanitiser(table(spark, folder, "part"), spec, impute=False).search
    return rounded(out, "eps", "noise", "sil", "overall_loss", "worst_excess", "score")


@query("d8_threshold_sanitiser", f"""
WITH RECURSIVE enc AS MATERIALIZED (SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS p_type, CAST(p_size AS DOUBLE) AS p_size FROM part),
pz AS MATERIALIZED ({z_sql('enc', 'p_partkey', ['p_type', 'p_size'])}), {dbscan_ctes('', 'pz', 2, 0.2, 30)},
rows AS MATERIALIZED (SELECT l.id, l.cluster, e.p_type AS z0, e.p_size AS z1 FROM lab l JOIN enc e ON e.p_partkey = l.id),
{medians_sql(20, 'vardi_zhang')}
SELECT p.p_partkey, p.p_type, p.p_size FROM mem m JOIN c20 c ON m.cluster = c.cluster JOIN part p ON p.p_partkey = m.id
WHERE m.cluster < 4 AND sqrt(0.5 * (m.z0 - c.z0) * (m.z0 - c.z0) + 0.5 * (m.z1 - c.z1) * (m.z1 - c.z1)) <= 6.5 + m.cluster""")
def thresholded(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    th = spark.createDataFrame([(c, 6.5 + c) for c in range(4)], "cluster int, threshold double")
    spec = TableSpec(row_id="p_partkey", features=("p_type", "p_size"))
    return threshold_sanitiser(p, spec, eps=0.2, min_samples=30, thresholds=th, max_iter=20)


@query("a12_member_distances", f"""{ROWS}, {converged_sql('plain')}
SELECT m.id AS p_partkey, m.cluster, round(sqrt(0.5 * (m.z0 - c.z0) * (m.z0 - c.z0) + 0.5 * (m.z1 - c.z1) * (m.z1 - c.z1)), 4) AS distance
FROM mem m JOIN centre c ON m.cluster = c.cluster""")
def measured(spark, folder):
    members, _ = label_and_measure(table(spark, folder, "part").select("p_partkey", *FEATURES), "p_partkey", FEATURES, EPS, MIN_SAMPLES)
    return rounded(members.select("p_partkey", "cluster", "distance"), "distance")


@query("o1_best_configuration", """
SELECT p_brand, p_size, count(DISTINCT p_type) AS k, max(p_retailprice) AS score FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) >= 2
ORDER BY score, p_size, p_brand LIMIT 1""")
def best(spark, folder):
    g = table(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.count_distinct("p_type").alias("k"), F.max("p_retailprice").alias("score"))
    return g.where(F.col("k") >= 2).orderBy("score", "p_size", "p_brand").limit(1)


@query("o2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
