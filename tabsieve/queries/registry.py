"""Query registry and the SQL fragments shared by several queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else F.col(c) for c in df.columns])


def z_sql(source: str, id_col: str, columns: Sequence[str], keep: Sequence[str] = ()) -> str:
    """SELECT of id, z0…, and kept columns, standardised by population deviation."""
    zs = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(columns))
    return f"SELECT {id_col} AS id, {', '.join([*keep, zs])} FROM {source}"


def distance_sql(n: int, metric: str = "euclidean", a: str = "a", b: str = "b", col: str = "z") -> str:
    if metric == "manhattan":
        return " + ".join(f"abs({a}.{col}{i} - {b}.{col}{i})" for i in range(n))
    return "sqrt(" + " + ".join(f"({a}.{col}{i} - {b}.{col}{i}) * ({a}.{col}{i} - {b}.{col}{i})" for i in range(n)) + ")"


def dbscan_ctes(p: str, points: str, dims: int, eps: float, min_samples: int, metric: str = "euclidean") -> str:
    """CTEs ending in ``{p}lab(id, cluster)`` from a relation ``points(id, z0…)``."""
    d = distance_sql(dims, metric)
    return f"""
    {p}e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM {points} a JOIN {points} b ON {d} <= {eps!r}),
    {p}core AS MATERIALIZED (SELECT u AS id FROM {p}e GROUP BY u HAVING count(*) >= {min_samples}),
    {p}ce AS MATERIALIZED (SELECT u, v FROM {p}e WHERE u IN (SELECT id FROM {p}core) AND v IN (SELECT id FROM {p}core)),
    {p}reach AS (SELECT id AS u, id AS v FROM {p}core UNION
                 SELECT r.u, c.v FROM {p}reach r JOIN {p}ce c ON r.v = c.u),
    {p}root AS MATERIALIZED (SELECT v AS id, min(u) AS root FROM {p}reach GROUP BY v),
    {p}num AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM {p}root),
    {p}bord AS MATERIALIZED (SELECT e.u AS id, min(n.cluster) AS cluster FROM {p}e e JOIN {p}num n ON e.v = n.id GROUP BY e.u),
    {p}lab AS MATERIALIZED (SELECT p.id, CAST(coalesce(n.cluster, b.cluster, -1) AS INTEGER) AS cluster
                            FROM {points} p LEFT JOIN {p}num n ON p.id = n.id LEFT JOIN {p}bord b ON p.id = b.id)"""


# Paired results derived from all order lines: dataset = line status, synthesizer = supplier,
# metric by return flag. Sums of whole cents keep every value exact in both engines.
METRIC_OF_FLAG = {"A": "privacy.k-map.score", "N": "stats.ks_test.marginal", "R": "sanity.nearest_syn_neighbor_distance.mean"}
DIRECTION_OF_FLAG = {"A": "maximize", "N": "maximize", "R": "minimize"}


def paired(spark: SparkSession, folder: str) -> DataFrame:
    def pick(d):
        e = None
        for k, v in d.items():
            e = F.when(F.col("l_returnflag") == k, v) if e is None else e.when(F.col("l_returnflag") == k, v)
        return e
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return (table(spark, folder, "lineitem")
            .groupBy(F.col("l_linestatus").alias("dataset"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("synthesizer"),
                     "l_returnflag")
            .agg((cents("l_discount") / F.count(F.lit(1))).alias("Orig"), (cents("l_tax") / F.count(F.lit(1))).alias("Sanitised"))
            .select("dataset", "synthesizer", pick(METRIC_OF_FLAG).alias("metric"), pick(DIRECTION_OF_FLAG).alias("direction"),
                    "Orig", "Sanitised"))


def _case(d):
    return "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"


PAIRED_SQL = f"""
    pr AS MATERIALIZED (SELECT l_linestatus AS dataset, 's' || CAST(l_suppkey AS VARCHAR) AS synthesizer, {_case(METRIC_OF_FLAG)} AS metric,
                  {_case(DIRECTION_OF_FLAG)} AS direction,
                  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS Orig,
                  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS Sanitised
           FROM lineitem GROUP BY l_linestatus, l_suppkey, l_returnflag),
    ch AS MATERIALIZED (SELECT *, split_part(metric, '.', 1) AS family,
                  sign(CASE direction WHEN 'maximize' THEN 1.0 ELSE -1.0 END * (Sanitised - Orig)) AS sgn,
                  CASE WHEN Orig <> 0 THEN CASE direction WHEN 'maximize' THEN 1.0 ELSE -1.0 END * (Sanitised - Orig) / abs(Orig) * 100.0
                       WHEN Sanitised = Orig THEN NULL
                       WHEN (Sanitised > Orig) = (direction = 'maximize') THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS dpct
           FROM pr)"""


def uniform_sql(seed: str, value: str) -> str:
    """Same uniform draw as ``seeded_uniform``."""
    return f"(CAST('0x' || substr(md5('{seed}|' || CAST({value} AS VARCHAR)), 1, 13) AS BIGINT) / {float(16 ** 13)!r})"
