"""Column scaling from one-pass summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.vectors import total


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    """Means and population standard deviations; a zero deviation counts as 1."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
                 *[F.min(c).cast("double").alias(f"l{i}") for i, c in enumerate(columns)],
                 *[F.max(c).cast("double").alias(f"h{i}") for i, c in enumerate(columns)]).first()
    # A constant column gets its value as mean and scale 1, whatever rounding leaves behind.
    flat = [row[f"l{i}"] == row[f"h{i}"] for i in range(len(columns))]
    mean = [(row[f"l{i}"] if flat[i] else row[f"m{i}"]) or 0.0 for i in range(len(columns))]
    std = [1.0 if flat[i] else row[f"s{i}"] for i in range(len(columns))]
    return mean, std


def standardise(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Add ``<prefix><column>`` with mean 0 and population deviation 1."""
    mean, std = moments(df, columns)
    return df.select("*", *[((F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))).alias(f"{prefix}{c}")
                            for c, m, s in zip(columns, mean, std)])


def min_max(df: DataFrame, columns: Sequence[str], by: DataFrame | None = None, prefix: str = "u_") -> DataFrame:
    """Scale to the [min, max] of ``by`` (default ``df``); a constant column maps to 0."""
    src = by if by is not None else df
    row = src.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns)
                    for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    out = []
    for i, c in enumerate(columns):
        lo, width = row[f"l{i}"], row[f"h{i}"] - row[f"l{i}"]
        out.append(((F.col(c).cast("double") - F.lit(lo)) / F.lit(width if width else 1.0)).alias(f"{prefix}{c}"))
    return df.select("*", *out)


def covariance(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Population covariance of all pairs in one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}")
                   for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"] or 0.0
    return out


def covariance_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, cov) for every ordered pair."""
    cov = covariance(df, columns)
    return df.sparkSession.createDataFrame(
        [(a, b, float(cov[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)],
        "col_a string, col_b string, cov double")


def precision(cov: np.ndarray, rcond: float = 1e-12) -> np.ndarray:
    return np.linalg.pinv(cov, rcond=rcond, hermitian=True)


class SingularCovariance(ValueError):
    """Columns depend on each other, so Mahalanobis distance is not defined on them."""


def whiten(df: DataFrame, columns: Sequence[str], cov: np.ndarray | None = None, prefix: str = "m_",
           strict: bool = False) -> DataFrame:
    """Rotate and scale so that Euclidean distance equals Mahalanobis distance.

    ``strict`` raises ``SingularCovariance`` instead of using the pseudo-inverse.
    """
    cov = covariance(df, columns) if cov is None else cov
    values, vectors = np.linalg.eigh(cov)
    floor = max(values.max(), 0.0) * 1e-12
    if strict and values.min() <= floor:
        raise SingularCovariance("singular covariance")
    factor = vectors * np.where(values > floor, 1.0 / np.sqrt(np.where(values > floor, values, 1.0)), 0.0)

    def axis(j) -> Column:
        return total([F.col(c).cast("double") * F.lit(float(factor[i, j])) for i, c in enumerate(columns)])

    return df.select("*", *[axis(j).alias(f"{prefix}{j}") for j in range(len(columns))])
