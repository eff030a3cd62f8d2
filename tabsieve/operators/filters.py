"""Row splits, column dropping and admissibility predicates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.ranking import exact_quantiles
from tabsieve.operators.encode import columns_of_type
from tabsieve.session import broadcast_if, materialise, null_safe_join


def split_noise(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, noise without its cluster column)."""
    return labelled.where(F.col("cluster") != -1), labelled.where(F.col("cluster") == -1).drop("cluster")


def threshold_split(df: DataFrame, thresholds: DataFrame, on_missing: str = "drop",
                    thresholds_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split by ``distance <= threshold`` of the row's cluster: (kept, removed without cluster/distance).

    Clusters without a threshold vanish from both sides (``drop``), are kept
    whole (``keep``) or raise (``error``).
    """
    if on_missing not in ("drop", "keep", "error"):
        raise ValueError(on_missing)
    if on_missing == "error" and not df.join(thresholds, "cluster", "left_anti").isEmpty():
        raise ValueError("cluster without a threshold")
    n = thresholds.count() if thresholds_rows is None else thresholds_rows
    joined = df.join(broadcast_if(thresholds.select("cluster", "threshold"), n * 32), "cluster",
                     "left" if on_missing == "keep" else "inner")
    keep = F.col("threshold").isNull() | (F.col("distance") <= F.col("threshold"))
    return (joined.where(keep).drop("threshold").select(*df.columns),
            joined.where(~keep).drop("cluster", "distance", "threshold"))


def tail_quantiles(df: DataFrame, tau: float, strata: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, strata, "distance", [1.0 - tau], ["cut"]).select(*strata, "cut")


def stratified_trim(df: DataFrame, tau: float, strata: Sequence[str] = ("cluster", "class")) -> DataFrame:
    """Keep rows at or below the (1 - tau) distance quantile of their stratum."""
    cuts = materialise(tail_quantiles(df, tau, strata))
    # One row per stratum; strata are far fewer than rows, the size is checked all the same.
    cuts = broadcast_if(cuts, cuts.count() * 48 * len(strata))
    return null_safe_join(df, cuts, list(strata)).where(F.col("distance") <= F.col("cut")).drop("cut").select(*df.columns)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> dict[str, int]:
    """Distinct non-null values per column, counted over (column, value) groups."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    rows = distinct_count_table(df, columns).collect()
    return {c: 0 for c in columns} | {r["column"]: r["n_distinct"] for r in rows}


def distinct_count_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    return (df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
            .distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with fewer than two distinct values, from one min/max pass."""
    columns = list(columns or df.columns)
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    return [c for i, c in enumerate(columns) if row[f"l{i}"] == row[f"h{i}"]]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    out = np.eye(len(columns))
    if pairs:
        row = df.agg(*[F.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"r{i}_{j}")
                       for i, j in pairs]).first()
        for i, j in pairs:
            out[i, j] = out[j, i] = np.nan if row[f"r{i}_{j}"] is None else row[f"r{i}_{j}"]
    return out


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    corr = correlation_matrix(df, columns)
    return df.sparkSession.createDataFrame(
        [(a, b, None if np.isnan(corr[i, j]) else float(corr[i, j]))
         for i, a in enumerate(columns) for j, b in enumerate(columns)], "col_a string, col_b string, corr double")


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.999) -> list[str]:
    """Numeric columns whose absolute correlation with an earlier one exceeds ``limit``."""
    columns = list(columns or columns_of_type(df, "numeric"))
    corr = np.abs(correlation_matrix(df, columns))
    return [c for i, c in enumerate(columns) if any(corr[i, j] > limit for j in range(i))]


def drop_duplicate_columns(df: DataFrame, limit: float = 0.999) -> DataFrame:
    return df.drop(*duplicate_columns(df, limit=limit))


def admissible(grid: DataFrame, n_rows: int | None = None, min_kept_share: float | None = None,
               min_kept: int | None = None, non_negative_silhouette: bool = False) -> DataFrame:
    """Configurations with two clusters or more, enough rows kept and the class cap met."""
    keep = (F.col("k") >= 2) & F.col("cap_ok")
    if min_kept_share is not None:
        keep = keep & (F.col("kept") >= min_kept_share * n_rows)
    if min_kept is not None:
        keep = keep & (F.col("kept") >= min_kept)
    if non_negative_silhouette:
        keep = keep & (F.col("sil") >= 0)
    return grid.where(keep)


def closest_cluster_count(grid: DataFrame, target: int) -> DataFrame:
    """Rows with the wanted cluster count, or else the nearest count present (smaller on ties)."""
    best = grid.agg(F.min_by("num_clusters", F.struct(F.abs(F.col("num_clusters") - target), F.col("num_clusters")))).first()[0]
    return grid.where(F.col("num_clusters") == best)


def known_label_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) >= 0)


def drop_ground_truth(results: DataFrame, column: str = "metric") -> DataFrame:
    return results.where(~F.col(column).endswith(".gt"))


def finite_or_null(column: str):
    c = F.col(column)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def finite_non_zero(df: DataFrame, column: str) -> DataFrame:
    """Drop null, infinite and zero changes before a signed-rank test."""
    return df.withColumn(column, finite_or_null(column)).where(F.col(column).isNotNull() & (F.col(column) != 0))


def size_guard(members: DataFrame, holdout: DataFrame, min_members: int = 50, min_holdout: int = 40) -> DataFrame:
    """One status row: enough rows on both sides or not."""
    counted = (members.select(F.lit(1).alias("m"), F.lit(0).alias("h"))
               .unionByName(holdout.select(F.lit(0).alias("m"), F.lit(1).alias("h")))
               .agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n_members"),
                    F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("n_holdout")))
    ok = (F.col("n_members") >= min_members) & (F.col("n_holdout") >= min_holdout)
    return counted.withColumn("status", F.when(ok, "ok").otherwise("too small"))
