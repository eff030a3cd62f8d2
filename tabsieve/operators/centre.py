"""Geometric medians of clusters and distances to them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.vectors import normalised, weighted_distance
from tabsieve.session import broadcast_if, materialise, null_safe_join, partitions

#: Clusters up to this size finish inside one task; larger ones iterate as Spark jobs.
LOCAL_ROWS = 20_000


def _next_centre(x: np.ndarray, w: np.ndarray, centre: np.ndarray, variant: str) -> np.ndarray | None:
    """One Weiszfeld step over weighted rows, or None when every row sits on the centre."""
    d = np.sqrt(((x - centre) ** 2).sum(axis=1))
    off = d > 0
    inv = np.where(off, w / np.where(off, d, 1.0), 0.0)
    return _combine((inv[:, None] * x).sum(axis=0), inv.sum(), w[~off].sum(), off.any(), centre, variant)


def _combine(pulled, inv_sum, on_centre, any_off, centre, variant):
    if not any_off:
        return None
    target = pulled / inv_sum
    if variant == "plain" or on_centre == 0:
        return target
    # Vardi and Zhang (2000): rows on the centre hold it back by their weight against the pull of the others.
    pull = inv_sum * float(np.linalg.norm(target - centre))
    held = min(1.0, on_centre / pull) if pull > 0 else 1.0
    return centre + (1.0 - held) * (target - centre)


def _iterate(x, w, variant, tol, max_iter):
    centre = np.average(x, axis=0, weights=w)
    for _ in range(max_iter):
        nxt = _next_centre(x, w, centre, variant)
        if nxt is None or np.sqrt(((nxt - centre) ** 2).sum()) < tol:
            return centre if nxt is None else nxt
        centre = nxt
    return centre


def geometric_medians(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("cluster",),
                      variant: str = "plain", tol: float = 1e-5, max_iter: int = 400,
                      local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row per group with its centre in ``m_<feature>``.

    ``plain`` skips rows on the current centre; ``vardi_zhang`` lets them hold the
    centre back. Copies are folded to weights first, so ``local_rows`` bounds what
    one task holds. All larger groups advance together, one job per step,
    and rest once they move less than ``tol``; ``max_iter`` steps end
    the search at the centre reached, in both variants.
    """
    if variant not in ("plain", "vardi_zhang"):
        raise ValueError(variant)
    keys = list(keys)
    names = [f"_x{i}" for i in range(len(features))]
    folded = materialise(df.groupBy(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
                         .agg(F.count(F.lit(1)).cast("double").alias("_w")))
    sizes = materialise(folded.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = key_types + ", " + ", ".join(f"`m_{c}` double" for c in features)
    if sizes.where(F.col("_n") > local_rows).isEmpty():
        small = folded
    else:
        small = null_safe_join(folded, broadcast_if(sizes.where(F.col("_n") <= local_rows), sizes.count() * 64), keys)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        centre = _iterate(rows[names].to_numpy(dtype=float), rows["_w"].to_numpy(), variant, tol, max_iter)
        return pd.DataFrame([[rows[k].iloc[0] for k in keys] + list(centre)],
                            columns=keys + [f"m_{c}" for c in features])

    out = small.groupBy(*keys).applyInPandas(solve, schema)
    large = sizes.where(F.col("_n") > local_rows).select(*keys)
    if large.isEmpty():
        return out
    centres = _large_medians(folded, large, keys, names, variant, tol, max_iter)
    return out.unionByName(df.sparkSession.createDataFrame(centres, schema))


def _large_medians(folded: DataFrame, large: DataFrame, keys: list[str], names: list[str], variant: str, tol: float, max_iter: int) -> list[tuple]:
    """(keys…, centre…) of groups too large for one task: one Spark job a step over array blocks that stay in memory.

    The driver holds one centre per large group and adds up one line of sums per group and task; there is at most one such
    group per ``local_rows`` distinct rows. Blocks lie in ranges of groups, so a task meets few groups and a group many tasks.
    """
    spark = folded.sparkSession
    groups = [tuple(r) for r in large.collect()]
    types = ", ".join(f"`{k}` {large.schema[k].dataType.simpleString()}" for k in keys)
    numbers = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], f"{types}, _g int")
    rows = null_safe_join(folded, broadcast_if(numbers, len(groups) * 64), keys).select("_g", *names, "_w")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                yield pd.DataFrame([{"g": g, "x": part[names].to_numpy(dtype=float).tobytes(), "w": part["_w"].to_numpy(dtype=float).tobytes()}])

    packed = materialise(rows.repartitionByRange(partitions(spark), "_g", *names).mapInPandas(pack, "g int, x binary, w binary"))
    blocks = packed.rdd.map(lambda r: (r.g, np.frombuffer(r.x).reshape(-1, len(names)), np.frombuffer(r.w))).persist(StorageLevel.MEMORY_AND_DISK)

    def first(part):
        return _added((g, np.concatenate([w @ x, [w.sum()]])) for g, x, w in part).items()

    sums = _added(blocks.mapPartitions(first).collect())
    centres = {g: s[:-1] / s[-1] for g, s in sums.items()}
    moving = dict(centres)
    for _ in range(max_iter):
        if not moving:
            break
        sums = _added(blocks.mapPartitions(partial(_pulls, moving)).collect())
        following = {g: _combine(s[:-3], s[-3], s[-2], s[-1] > 0, moving[g], variant) for g, s in sums.items()}
        centres.update({g: c for g, c in following.items() if c is not None})
        moving = {g: c for g, c in following.items() if c is not None and np.sqrt(((c - moving[g]) ** 2).sum()) >= tol}
    blocks.unpersist()
    return [(*groups[g], *c.tolist()) for g, c in centres.items()]


def _added(lines: Iterable[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for g, s in lines:
        out[g] = out[g] + s if g in out else s
    return out


def _pulls(centres: dict[int, np.ndarray], blocks: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterable[tuple[int, np.ndarray]]:
    """Per group that still moves, the sums of one step: weighted rows over distance, weights over distance, weight on the centre, rows off it."""
    def one(x, w, centre):
        d = np.sqrt(((x - centre) ** 2).sum(axis=1))
        off = d > 0
        inv = np.where(off, w / np.where(off, d, 1.0), 0.0)
        return np.concatenate([inv @ x, [inv.sum(), w[~off].sum(), off.sum()]])

    return _added((g, one(x, w, centres[g])) for g, x, w in blocks if g in centres).items()


def centre_distances(df: DataFrame, centres: DataFrame, features: Sequence[str], keys: Sequence[str] = ("cluster",),
                     weights: dict[str, float] | None = None, n_centres: int | None = None) -> DataFrame:
    """Add ``distance`` = sqrt(sum w (x - m)^2) to the centre of the row's group."""
    n = centres.count() if n_centres is None else n_centres
    joined = df.join(broadcast_if(centres, n * 8 * (len(features) + len(keys))), list(keys))
    d = weighted_distance([F.col(c).cast("double") for c in features], [F.col(f"m_{c}") for c in features],
                          normalised(weights, features))
    return joined.withColumn("distance", d).drop(*[f"m_{c}" for c in features])


def density_histogram(df: DataFrame, keys: Sequence[str] = ("cluster",), value: str = "distance",
                      bins: int = 30) -> DataFrame:
    """Equal-width bins over each group's own range: (bin, lower, upper, n, density)."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
                                 F.count(value).alias("total"))
    span = materialise(span)
    # A group of equal values is widened by one half on both sides.
    flat = F.col("lo") == F.col("hi")
    span = (span.withColumn("lo", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")))
            .withColumn("width", F.when(flat, 1.0).otherwise(F.col("hi") - F.col("lo")) / F.lit(float(bins))))
    raw = F.floor((F.col(value) - F.col("lo")) / F.col("width"))
    binned = (df.join(broadcast_if(span, span.count() * 64), keys)
              .withColumn("bin", F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int"))
              .groupBy(*keys, "bin", "lo", "width", "total").agg(F.count(F.lit(1)).alias("n")))
    return binned.select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
                         (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"), "n",
                         (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))
