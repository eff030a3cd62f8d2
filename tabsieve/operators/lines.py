"""Neighbour counts of rows that lie on few lines.

Rows equal in all columns but one lie on a line. Where lines are few against the rows, two lines at a known distance
leave a radius along the line, so a row finds its neighbours on another line by binary search instead of one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.tiles import GROUP_TILES, MAX_TILES, SLACK, TILE_SCHEMA, Tiles, fold_groups, tile_pairs
from tabsieve.session import materialise, partitions

#: Rows a line holds on average at least; with fewer a binary search gains nothing.
MIN_LINE_ROWS = 64
#: Rows of a piece of a line.
MIN_PIECE_ROWS, MAX_PIECE_ROWS = 512, 16_384
#: Distances this close to the limit are taken column by column.
CLOSE = 1e-12


def line_tiles(points: DataFrame, dims: int) -> tuple[Tiles, int] | None:
    """Folded points as tiles that are pieces of lines, values along the line ascending, and the column along them.

    The boxes have all columns, ``x`` only that one. None where lines hold too few rows, or a value is no finite number.
    """
    spark, names = points.sparkSession, [f"_x{i}" for i in range(dims)]
    if dims < 2:
        return None
    odd = [F.max((F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int")).alias(f"o{c}") for c in names]
    facts = points.agg(F.count(F.lit(1)).alias("n"), *odd, *[F.approx_count_distinct(c).alias(c) for c in names]).first()
    n = facts["n"]
    if not n or any(facts[f"o{c}"] for c in names):
        return None
    # neighbouring lines lie side by side when the column with the most values is sorted last
    *others, axis = sorted(range(dims), key=lambda i: facts[names[i]])
    kept = [names[i] for i in others]
    lines = points.groupBy(*kept).agg(F.count(F.lit(1)).alias("n")).count()
    limit = min(max(math.ceil(n / (2 * GROUP_TILES * partitions(spark))), MIN_PIECE_ROWS), MAX_PIECE_ROWS)
    if n < MIN_LINE_ROWS * lines or lines + n / limit + partitions(spark) > MAX_TILES:
        return None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def piece():
            nonlocal number, held, size
            at, w = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            lo, hi = np.zeros(dims), np.zeros(dims)
            lo[others] = hi[others] = held[0][0]
            lo[axis], hi[axis] = at[0], at[-1]
            made = pd.DataFrame([{"part": part, "number": number, "n": len(at), "weight": float(w.sum()), "lo": lo, "hi": hi,
                                  "ids": np.zeros(len(at), dtype=np.int64).tobytes(), "x": at.tobytes(), "w": w.tobytes(), "tag": b""}])
            number, held, size = number + 1, [], 0
            return made

        for pdf in batches:
            rest, at, w = pdf[kept].to_numpy(dtype=float), pdf[names[axis]].to_numpy(dtype=float), pdf["copies"].to_numpy(dtype=float)
            ends = [*np.flatnonzero((rest[1:] != rest[:-1]).any(axis=1)) + 1, len(at)]
            first = 0
            for end in ends:
                while first < end:
                    if held and ((rest[first] != held[0][0]).any() or size >= limit):
                        yield piece()
                    last = min(end, first + limit - size)
                    held.append((rest[first], at[first:last], w[first:last]))
                    size, first = size + last - first, last
        if held:
            yield piece()

    order = [*kept, names[axis]]
    pieces = materialise(points.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(*names, "copies")
                         .mapInPandas(cut, "part int, number int, " + TILE_SCHEMA.replace("tile int, ", "")))
    sizes = {r["part"]: r["n"] for r in pieces.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    numbered = pieces.join(F.broadcast(spark.createDataFrame(starts, "part int, start int")), "part")
    tiles = numbered.withColumn("tile", F.col("start") + F.col("number")).select(*[f.split()[0] for f in TILE_SCHEMA.split(", ")])
    return Tiles(materialise(tiles), 1, n, 0, total), axis


def line_histogram(lines: Tiles, axis: int, dims: int, eps: float, metric: str) -> DataFrame:
    """(n_neighbours, n_rows) per piece of a line: rows within ``eps``, themselves and copies counted."""
    boxes = lines.df.select("tile", "lo").toPandas()
    corner = np.zeros((int(boxes["tile"].max()) + 1, dims))
    corner[boxes["tile"].to_numpy()] = np.stack(boxes["lo"].to_numpy())
    shared = lines.df.sparkSession.sparkContext.broadcast(corner)
    far = F.col("far") > eps * (1 - SLACK)
    pairs = tile_pairs(lines, lines, metric, reach=eps).withColumn("payload", far | (F.col("i") == F.col("j")))
    add = np.abs if metric == "manhattan" else np.square

    def start(a):
        return np.zeros(len(a.ids))

    def step(count, a, b, near, far, w_j):
        if b is None:
            count += w_j
            return
        x, y = a.x[:, 0], b.x[:, 0]
        apart = [float(add(p - q)) for p, q in zip(shared.value[a.tile], shared.value[b.tile])]
        rest = sum(apart[:axis] + apart[axis + 1:])
        limit = eps if metric == "manhattan" else eps * eps
        inner, outer = limit * (1 - CLOSE) - rest, limit * (1 + CLOSE) - rest
        if outer < 0:
            return
        if metric != "manhattan":
            inner, outer = (math.sqrt(v) if v >= 0 else -1.0 for v in (inner, outer))
        rounding = 8 * np.finfo(float).eps * max(abs(x[0]), abs(x[-1]), abs(y[0]), abs(y[-1]))
        inner, outer = inner - rounding, outer + rounding
        low, high = np.searchsorted(y, x - outer, "left"), np.searchsorted(y, x + outer, "right")
        some = np.flatnonzero(low < high)
        if not len(some):
            return
        w = np.concatenate([[0.0], np.cumsum(b.w)])
        # where the outermost values are surely within the limit, so are all between them
        low, high = low[some], high[some]
        sure = (x[some] - y[low] <= inner) & (y[high - 1] - x[some] <= inner)
        count[some[sure]] += w[high[sure]] - w[low[sure]]
        for row, first, last in zip(some[~sure], low[~sure], high[~sure]):
            at = first + np.searchsorted(y[first:last], [x[row] - inner, x[row] + inner]) if inner >= 0 else (first, first)
            edges = np.concatenate([np.arange(first, max(at[0], first)), np.arange(max(at[1], first), last)])
            count[row] += w[max(at[1], first)] - w[max(at[0], first)]
            total = np.zeros(len(edges))
            for k in range(dims):
                total += add(x[row] - y[edges]) if k == axis else apart[k]
            count[row] += b.w[edges[(total if metric == "manhattan" else np.sqrt(total)) <= eps]].sum()

    def finish(count, a):
        found, at = np.unique(count, return_inverse=True)
        return pd.DataFrame({"n_neighbours": found.astype(np.int64), "n_rows": np.bincount(at, a.w).astype(np.int64)})

    return fold_groups(lines, lines, pairs, start, step, finish, "n_neighbours long, n_rows long")
