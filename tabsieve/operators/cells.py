"""Random forests of classes on cells.

Thresholds are quantiles of all rows, so rows between the same thresholds are one cell with a count per class. A tree
is grown on the cells: the number of rows decides only the counts, and a task grows whole trees by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.ranking import value_positions
from tabsieve.functions.vectors import total
from tabsieve.session import materialise

#: Cells a feature is cut into at most.
BINS = 32
#: Numbers (cells times classes and features) that a task holds; with more cells MLlib grows the trees.
MAX_CELL_NUMBERS = 2_000_000
#: Numbers of the tables of class counts that are looked at together.
COUNT_NUMBERS = 1 << 21


def exact_thresholds(rows: DataFrame, column: str, bins: int = BINS) -> list[float]:
    """Ascending thresholds that cut ``column`` into at most ``bins`` parts, halfway between neighbouring values.

    With more values than that, a threshold is the one nearest to each of the quantiles of all rows.
    """
    at = materialise(value_positions(rows, [], column))
    few = [float(r[0]) for r in at.select(column).orderBy(column).limit(bins + 1).collect()]
    if len(few) <= bins:
        return _between(list(zip(few[:-1], few[1:])))
    n = at.agg(F.max("total")).first()[0]
    wanted = [n * k / bins for k in range(1, bins)]
    value, before = F.col(column), F.col("before")
    held = at.agg(*[F.max(F.when(before < w, F.struct(value, before, "n"))).alias(f"h{i}") for i, w in enumerate(wanted)]).first()
    near = at.agg(*[f.alias(f"{name}{i}") for i, h in enumerate(held) for name, f in (
        ("low", F.max(F.when(before < h["before"], value))), ("high", F.min(F.when(before > h["before"], value))))]).first()
    pairs = []
    for i, (w, h) in enumerate(zip(wanted, held)):
        low, high = near[f"low{i}"], near[f"high{i}"]
        if low is not None and (high is None or w - h["before"] <= h["before"] + h["n"] - w):
            pairs.append((float(low), float(h[column])))
        elif high is not None:
            pairs.append((float(h[column]), float(high)))
    return _between(pairs)


def _between(pairs: Sequence[tuple[float, float]]) -> list[float]:
    """A threshold that keeps the first value of each pair on its left and the second on its right; NaN is above all numbers."""
    middles = ((a, b, a + (b - a) / 2) for a, b in pairs)
    return sorted({m if a <= m < b else a for a, b, m in middles})


def cell_columns(features: Sequence[str], thresholds: Sequence[Sequence[float]]) -> list[Column]:
    """``_c0``…: how many thresholds lie below the value."""
    return [total([F.lit(0), *[(F.col(c) > F.lit(t)).cast("int") for t in at]]).alias(f"_c{j}") for j, (c, at) in enumerate(zip(features, thresholds))]


def count_cells(rows: DataFrame, features: Sequence[str], thresholds: Sequence[Sequence[float]], label: str = "label") -> DataFrame:
    """(_c0…, label, n): rows per cell and label."""
    names = [f"_c{j}" for j in range(len(features))]
    return rows.select(*cell_columns(features, thresholds), F.col(label).cast("double").alias("label")).groupBy(*names, "label").agg(F.count(F.lit(1)).alias("n"))


def _best_splits(node: np.ndarray, x: np.ndarray, w: np.ndarray, allowed: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the feature (-1 where no split makes it purer) and the last bin on the left, by Gini impurity.

    ``node`` numbers the rows of ``x`` and ``w`` (counts per class) ascending from 0.
    """
    n_nodes, classes = len(allowed), w.shape[1]
    feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes, dtype=np.int64)
    gain = np.full(n_nodes, 1e-14)
    at_once = max(1, COUNT_NUMBERS // (bins * classes))
    for first in range(0, n_nodes, at_once):
        rows = slice(*np.searchsorted(node, [first, first + at_once]))
        here = slice(first, min(first + at_once, n_nodes))
        size = here.stop - first
        for j in range(x.shape[1]):
            key = (node[rows] - first) * bins + x[rows, j]
            left = np.stack([np.bincount(key, w[rows, k], size * bins) for k in range(classes)], axis=-1).reshape(size, bins, classes).cumsum(axis=1)
            whole, left = left[:, -1:], left[:, :-1]
            right = whole - left
            n_left, n_right = left.sum(axis=2), right.sum(axis=2)
            n = n_left + n_right
            with np.errstate(divide="ignore", invalid="ignore"):
                # the impurity that a split takes away, as a share of the rows of the node
                got = ((left ** 2).sum(axis=2) / n_left + (right ** 2).sum(axis=2) / n_right - (whole ** 2).sum(axis=2) / n) / n
            got[~((n_left > 0) & (n_right > 0))] = -1.0
            got[~allowed[here, j]] = -1.0
            best = got.argmax(axis=1)
            top = got[np.arange(size), best]
            better = np.flatnonzero(top > gain[here])
            gain[first + better], feature[first + better], cut[first + better] = top[better], j, best[better]
    return feature, cut


def grow(x: np.ndarray, w: np.ndarray, asked: np.ndarray, depth: int, bins: int, rng: np.random.Generator) -> np.ndarray:
    """Class shares that one tree, grown on cells ``x`` with counts per class ``w``, gives the cells ``asked``.

    A node looks at a random choice of as many features as the square root of their number, rounded up.
    """
    keep = w.sum(axis=1) > 0
    x, w = x[keep], w[keep]
    out = np.zeros((len(asked), w.shape[1]))
    node, at, open_rows = np.zeros(len(x), dtype=np.int64), np.zeros(len(asked), dtype=np.int64), np.arange(len(asked))
    dims = x.shape[1]
    some = math.ceil(math.sqrt(dims))
    for level in range(depth + 1):
        if not len(x) or not len(open_rows):
            break
        n_nodes = int(node.max()) + 1
        counts = np.stack([np.bincount(node, w[:, k], n_nodes) for k in range(w.shape[1])], axis=1)
        feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes, dtype=np.int64)
        mixed = np.flatnonzero(((counts > 0).sum(axis=1) > 1) & (np.bincount(node, minlength=n_nodes) > 1)) if level < depth else []
        if len(mixed):
            number = np.full(n_nodes, -1)
            number[mixed] = np.arange(len(mixed))
            rows = np.flatnonzero(number[node] >= 0)
            rows = rows[np.argsort(number[node[rows]], kind="stable")]
            allowed = rng.random((len(mixed), dims)).argsort(axis=1) < some
            feature[mixed], cut[mixed] = _best_splits(number[node[rows]], x[rows], w[rows], allowed, bins)
        ends = feature[at] < 0
        done = counts[at[ends]]
        out[open_rows[ends]] = done / done.sum(axis=1, keepdims=True)
        # the halves of a split node are numbered anew
        split = np.cumsum(feature >= 0) - 1
        stay = feature[node] >= 0
        x, w, node = x[stay], w[stay], node[stay]
        node = 2 * split[node] + (x[np.arange(len(x)), feature[node]] > cut[node])
        open_rows, at = open_rows[~ends], at[~ends]
        at = 2 * split[at] + (asked[open_rows, feature[at]] > cut[at])
    return out


def forest_predictions(train: DataFrame, test: DataFrame, dims: int, classes: int, trees: int, depth: int, seed: int = 42) -> DataFrame | None:
    """(label, prediction, n): what a forest fitted on the rows counted in ``train`` says of those counted in ``test``.

    The rows of a cell enter a tree as often as that many draws with replacement take them. None where the cells are
    too many for a task.
    """
    spark = train.sparkSession
    names = [f"_c{j}" for j in range(dims)]
    sizes = [df.select(*names).distinct().count() for df in (train, test)]
    if sum(sizes) * (classes + dims) > MAX_CELL_NUMBERS:
        return None
    seen, met = (df.orderBy(*names, "label").toPandas() for df in (train, test))
    x, of = np.unique(seen[names].to_numpy(dtype=np.int64).reshape(-1, dims), axis=0, return_inverse=True)
    w = np.zeros((len(x), classes))
    w[of.ravel(), seen["label"].to_numpy(dtype=np.int64)] = seen["n"]
    asked, which = np.unique(met[names].to_numpy(dtype=np.int64).reshape(-1, dims), axis=0, return_inverse=True)
    bins = int(max(x.max(initial=0), asked.max(initial=0))) + 2
    shared = spark.sparkContext.broadcast((x, w, asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, w, asked = shared.value
        votes = np.zeros((len(asked), classes))
        for pdf in batches:
            for tree in pdf["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                votes += grow(x, rng.poisson(w).astype(float), asked, depth, bins, rng)
        yield pd.DataFrame({"votes": [votes.tobytes()]})

    tasks = max(1, min(trees, 2 * spark.sparkContext.defaultParallelism))
    votes = np.zeros((len(asked), classes))
    for row in materialise(spark.range(0, trees, 1, tasks).mapInPandas(run, "votes binary")).toLocalIterator():
        votes += np.frombuffer(row["votes"]).reshape(votes.shape)
    shared.unpersist()
    # votes are added in any order, so ties are told to a part in a billion
    best = np.round(votes / trees, 9).argmax(axis=1) if len(asked) else np.zeros(0, dtype=np.int64)
    met["prediction"] = best[which.ravel()].astype(float)
    rows = met.groupby(["label", "prediction"], as_index=False)["n"].sum()
    return spark.createDataFrame([(float(a), float(b), int(n)) for a, b, n in rows[["label", "prediction", "n"]].itertuples(index=False)],
                                 "label double, prediction double, n long")
