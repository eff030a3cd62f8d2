"""Exact silhouette by branch and bound over clusters: bounds from cluster summaries decide which clusters a tile has to open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.tiles import SLACK, Tiles, block_distance, build_tiles, distance_strips, fold_pairs, tile_pairs, with_tags
from tabsieve.session import materialise

#: Ways in which the tiles of one cluster are dealt, so that the pairs of a large cluster are not made by one task.
SALTS = 8
#: Rounding of coordinates, relative to the largest one.
ROUNDING = 1e-12


def label_tiles(tiles: Tiles, labels: DataFrame, width: int) -> Tiles:
    """Tiles whose tags are the clusters of their points, one column per config in rising order of ``config_id``."""

    def list_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, ids in zip(pdf["tile"], pdf["ids"]):
                yield pd.DataFrame({"tile": np.int32(tile), "pid": np.frombuffer(ids, dtype=np.int64)})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        mat = rows.sort_values(["pid", "config_id"])["cluster"].to_numpy(dtype=float)
        return pd.DataFrame([{"tile": int(rows["tile"].iloc[0]), "tag": mat.tobytes()}])

    located = tiles.df.select("tile", "ids").mapInPandas(list_ids, "tile int, pid long").join(labels, "pid")
    marked = with_tags(tiles, located.groupBy("tile").applyInPandas(pack, "tile int, tag binary"), width)
    marked.df = materialise(marked.df)
    return marked


def cluster_cells(marked: Tiles) -> DataFrame:
    """(config, cluster, tile, n, s0…, q0…): rows, sums and sums of squares of each cluster inside each tile."""
    dims, width = marked.dims, marked.tags
    names = [f"{k}{i}" for k in "sq" for i in range(dims)]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, x, w, tag in zip(pdf["tile"], pdf["x"], pdf["w"], pdf["tag"]):
                w = np.frombuffer(w)
                x, tag = np.frombuffer(x).reshape(len(w), dims), np.frombuffer(tag).reshape(len(w), width)
                for c in range(width):
                    found, at = np.unique(tag[:, c], return_inverse=True)
                    total = lambda v: np.bincount(at, v, len(found))
                    sums = [total(w * x[:, i]) for i in range(dims)] + [total(w * x[:, i] ** 2) for i in range(dims)]
                    yield pd.DataFrame({"config": np.int32(c), "cluster": found.astype(np.int64), "tile": np.int32(tile),
                                        "n": total(w), **dict(zip(names, sums))})

    return marked.df.select("tile", "x", "w", "tag").mapInPandas(
        cells, "config int, cluster long, tile int, n double, " + ", ".join(f"{c} double" for c in names))


def cluster_summaries(cells: DataFrame, dims: int) -> DataFrame:
    """One row per cluster: centre ``_x…``; tags config, cluster, rows, and the variance of each column."""
    names = [f"{k}{i}" for k in "sq" for i in range(dims)]
    whole = cells.groupBy("config", "cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    centre = [F.col(f"s{i}") / F.col("n") for i in range(dims)]
    square = [F.col(f"q{i}") / F.col("n") for i in range(dims)]
    spread = [F.greatest(F.lit(0.0), q - c * c) + q * ROUNDING for c, q in zip(centre, square)]
    return whole.select(F.monotonically_increasing_id().alias("pid"), F.lit(1).alias("copies"), *[c.alias(f"_x{i}") for i, c in enumerate(centre)],
                        *[v.cast("double").alias(f"_t{i}") for i, v in enumerate([F.col("config"), F.col("cluster"), F.col("n"), *spread])])


def clusters_to_open(marked: Tiles, summaries: DataFrame, metric: str) -> DataFrame:
    """(tile, config array, cluster array, note): clusters of the rows of a tile and those that can be the nearest other one of some row.

    The mean distance to a cluster is at least the distance to its centre (a norm is convex) and at most the root of the
    mean square (per column for Manhattan). A cluster above the least upper bound of every row is never opened. ``note``
    holds (config, cluster, rows of the cluster) as numbers.
    """
    centres = build_tiles(materialise(summaries), marked.dims, tags=3 + marked.dims)
    width = marked.tags

    def start(a):
        return {"least": np.full((width, len(a.ids)), np.inf), "open": [[] for _ in range(width)], "own": []}

    def step(state, a, b, near, far, w_j):
        for c in np.unique(b.tag[:, 0]).astype(int):
            here = b.tag[:, 0] == c
            cluster, n, spread = b.tag[here, 1], b.tag[here, 2], b.tag[here, 3:]
            low = block_distance(a.x, b.x[here], metric)
            if metric == "manhattan":
                high = sum(np.sqrt((a.x[:, i, None] - b.x[here, i][None, :]) ** 2 + spread[None, :, i]) for i in range(a.x.shape[1]))
            else:
                high = np.sqrt(low ** 2 + spread.sum(axis=1)[None, :])
            own = a.tag[:, c, None] == cluster[None, :]
            state["own"] += [(c, k, m) for k, m in zip(cluster[own.any(axis=0)], n[own.any(axis=0)])]
            low[own], high[own] = np.inf, np.inf
            state["least"][c] = np.minimum(state["least"][c], high.min(axis=1))
            state["open"][c] = [p for p in state["open"][c] if reachable(state, a, c, p[2][:, None]).any()]
            keep = reachable(state, a, c, low)
            state["open"][c] += [(cluster[k], n[k], low[:, k].copy()) for k in np.flatnonzero(keep)]

    def reachable(state, a, c, low):
        least = state["least"][c]
        limit = least * (1 + SLACK) + ROUNDING * np.abs(a.x).max(initial=0.0) * a.x.shape[1]
        return ((low <= limit[:, None]) & np.isfinite(low)).any(axis=0)

    def finish(state, a):
        found = {(c, k): m for c, k, m in state["own"]}
        found |= {(c, p[0]): p[1] for c in range(width) for p in state["open"][c]}
        note = np.array([(c, k, m) for (c, k), m in sorted(found.items())], dtype=float).reshape(-1, 3)
        return pd.DataFrame([{"tile": a.tile, "config": note[:, 0].astype(np.int32), "cluster": note[:, 1].astype(np.int64), "note": note.tobytes()}])

    return fold_pairs(marked, centres, tile_pairs(marked, centres, metric), start, step, finish,
                      "tile int, config array<int>, cluster array<long>, note binary")


def pairs_to_open(opened: DataFrame, cells: DataFrame) -> DataFrame:
    """Tile pairs (i, j) in which j holds rows of a cluster that i opens."""
    wanted = (opened.select(F.col("tile").alias("i"), F.explode(F.arrays_zip("config", "cluster")).alias("c"))
              .select("i", "c.config", "c.cluster", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    held = cells.select("config", "cluster", F.col("tile").alias("j"), F.pmod("tile", F.lit(SALTS)).alias("salt"))
    return (wanted.join(held, ["config", "cluster", "salt"]).select("i", "j").distinct()
            .select("i", "j", F.lit(0.0).alias("near"), F.lit(0.0).alias("far"), F.lit(0.0).alias("w_j")))


def silhouette_points(tiles: Tiles, labels: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Mean silhouette per config from folded points: (config_id, silhouette).

    Noise is a cluster of its own, a row alone in its cluster scores 0, and a
    labelling with a single label or only single-row labels scores -1.
    ``labels`` holds (pid, config_id, cluster). A row keeps one sum per cluster that its tile opens; sizes and
    centres of clusters stay a table.
    """
    spark = tiles.df.sparkSession
    configs = [r["config_id"] for r in labels.select("config_id").distinct().orderBy("config_id").collect()]
    width = len(configs)
    marked = label_tiles(tiles, labels, width)
    cells = materialise(cluster_cells(marked))
    measured = (cells.groupBy("config", "cluster").agg(F.sum("n").alias("n")).groupBy("config")
                .agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")))
    named = spark.createDataFrame(list(enumerate(configs)), "config int, config_id int")
    measured = materialise(measured.join(named, "config"))
    valid = measured.where((F.col("labels") > 1) & (F.col("labels") < F.col("rows"))).select("config", "config_id", "rows")
    cells = cells.join(F.broadcast(valid.select("config")), "config")  # one row per config
    opened = materialise(clusters_to_open(marked, cluster_summaries(cells, marked.dims), metric))
    noted = Tiles(marked.df.join(opened.select("tile", "note"), "tile"), marked.dims, marked.rows, width, marked.n_tiles)

    def start(a):
        note = np.frombuffer(a.note).reshape(-1, 3)
        known = [note[note[:, 0] == c, 1:] for c in range(width)]
        return known, [np.zeros((len(a.ids), len(k))) for k in known]

    def step(state, a, b, near, far, w_j):
        known, sums = state
        used = np.zeros(len(b.ids), dtype=bool)
        for c in range(width):
            used |= np.isin(b.tag[:, c], known[c][:, 0])
        x, w, tag = b.x[used], b.w[used], b.tag[used]
        held = [np.flatnonzero(np.isin(known[c][:, 0], tag[:, c])) for c in range(width)]
        member = [(tag[:, c, None] == known[c][None, held[c], 0]) * w[:, None] for c in range(width)]
        for rows, d in distance_strips(a.x, x, metric):
            for c in range(width):
                if len(held[c]):
                    sums[c][rows, held[c]] += d @ member[c]

    def finish(state, a):
        known, sums = state
        out = []
        for c in range(width):
            if not len(known[c]):
                continue
            own, at = np.searchsorted(known[c][:, 0], a.tag[:, c]), np.arange(len(a.ids))
            n_own = known[c][own, 1]
            inner = sums[c][at, own] / np.maximum(n_own - 1, 1)
            other = sums[c] / known[c][None, :, 1]
            other[at, own] = np.inf
            outer = other.min(axis=1)
            top = np.maximum(inner, outer)
            s = np.where((n_own == 1) | (top == 0), 0.0, (outer - inner) / np.where(top == 0, 1.0, top))
            out.append((c, float((s * a.w).sum())))
        return pd.DataFrame(out, columns=["config", "s"]) if out else None

    parts = fold_pairs(noted, marked, pairs_to_open(opened, cells), start, step, finish, "config int, s double")
    means = parts.groupBy("config").agg(F.sum("s").alias("s")).join(valid, "config").select("config_id", (F.col("s") / F.col("rows")).alias("silhouette"))
    return named.select("config_id").join(means, "config_id", "left").withColumn("silhouette", F.coalesce("silhouette", F.lit(-1.0)))
