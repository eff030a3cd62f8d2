"""Row-vector expressions over scalar columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def weighted_distance(cols: Sequence[Column], centre: Sequence[Column], weights: Sequence[float]) -> Column:
    """sqrt(sum w (x - m)^2), weights already normalised."""
    return F.sqrt(total([F.lit(float(w)) * (x - m) * (x - m) for x, m, w in zip(cols, centre, weights)]))


def distance(a: Sequence[Column], b: Sequence[Column], metric: str = "euclidean") -> Column:
    if metric == "manhattan":
        return total([F.abs(x - y) for x, y in zip(a, b)])
    if metric == "euclidean":
        return F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b)]))
    raise ValueError(f"unknown metric {metric!r}")


def normalised(weights: dict[str, float] | None, columns: Sequence[str]) -> list[float]:
    """Feature weights scaled to sum one; columns without a weight count 1."""
    raw = [float((weights or {}).get(c, 1.0)) for c in columns]
    return [w / sum(raw) for w in raw]


def expand_array(df, column: str, size: int, prefix: str = "feature_"):
    """Turn an array column into scalar columns ``feature_0 …``."""
    return df.select(*[c for c in df.columns if c != column],
                     *[F.col(column)[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])
