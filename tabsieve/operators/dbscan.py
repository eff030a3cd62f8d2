"""Exact DBSCAN labels for one or many configurations, computed together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.ranking import number_rows
from tabsieve.operators.components import connected_components
from tabsieve.operators.tiles import (MAX_TILE_ROWS, SLACK, Tiles, box_reach, build_tiles, distance_strips,
                                      fold_copies, fold_groups, fold_pairs, rows_in_reach, tile_pairs, with_tags)
from tabsieve.session import materialise, spread_lookup

NOISE = -1
_FAR = np.iinfo(np.int64).max


def neighbour_degrees(tiles: Tiles, eps: Sequence[float], metric: str, enough: Sequence[int] | None = None,
                      pairs: DataFrame | None = None) -> DataFrame:
    """(tile, tag): weighted neighbour count per row and eps, the row itself included.

    Tile pairs that lie wholly within the smallest eps add their total weight
    without touching a row. ``enough`` names per eps the count beyond which the
    exact number no longer matters; rows that reach it take no further part, so
    a dense region costs little more than its own tiles.
    """
    need = None if enough is None else np.asarray(enough, dtype=float)
    inner, outer = min(eps), max(eps)
    pairs = (tile_pairs(tiles, tiles, metric, reach=outer) if pairs is None else pairs).withColumn(
        "payload", (F.col("far") > inner * (1 - SLACK)) | (F.col("i") == F.col("j")))

    def start(a):
        return np.zeros((len(a.ids), len(eps)))

    def step(deg, a, b, near, far, w_j):
        if b is None:
            deg += w_j
            return
        near_a, far_a = box_reach(a.x, b.x, metric)
        inside = far_a <= inner * (1 - SLACK)
        deg[inside] += b.w.sum()
        wanted = ~inside & (near_a <= outer * (1 + SLACK))
        if need is not None:
            wanted &= (deg < need[None, :]).any(axis=1)
        ia = np.flatnonzero(wanted)
        if not len(ia):
            return
        ib = rows_in_reach(b.x, a.x[ia], outer, metric)
        for rows, d in distance_strips(a.x[ia], b.x[ib], metric):
            for e, limit in enumerate(eps):
                deg[ia[rows], e] += (d <= limit) @ b.w[ib]

    def finish(deg, a):
        return pd.DataFrame([{"tile": a.tile, "tag": deg.tobytes()}])

    # counts that may stop early go nearest tile first
    fold = fold_groups if need is None else fold_pairs
    return fold(tiles, tiles, pairs, start, step, finish, "tile int, tag binary")


def _local_roots(x: np.ndarray, ids: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """Smallest id reachable inside one block, by repeated neighbour minima over strips."""
    whole = [(rows, d <= eps) for rows, d in distance_strips(x, x, metric)] if len(x) <= 4 * MAX_TILE_ROWS else None
    root = ids.copy()
    while True:
        strips = whole if whole is not None else ((rows, d <= eps) for rows, d in distance_strips(x, x, metric))
        nxt = root.copy()
        for rows, adj in strips:
            nxt[rows] = np.where(adj, root[None, :], _FAR).min(axis=1)
        # a root found for a neighbour is also the root of whatever that neighbour points to
        nxt = nxt[np.searchsorted(ids, nxt)]
        if (nxt == root).all():
            return root
        root = nxt


def dbscan(df: DataFrame, id_col: str, features: Sequence[str], configs: Sequence[tuple[float, int]],
           metric: str = "euclidean") -> DataFrame:
    """``df`` plus (config_id, cluster), one copy of the rows per configuration.

    A row is core with at least ``min_samples`` weighted neighbours within eps
    (itself included, limit inclusive). Clusters are numbered from 0 by their
    smallest core id, a border row joins the lowest-numbered cluster it touches,
    the rest get -1. ``features`` must be standardised already and never null.
    """
    return attach_labels(df, id_col, features, *label_points(df, id_col, features, configs, metric))


def label_points(df: DataFrame, id_col: str, features: Sequence[str], configs: Sequence[tuple[float, int]],
                 metric: str = "euclidean") -> tuple[DataFrame, DataFrame, Tiles]:
    """Distinct points, their labels (pid, config_id, cluster) and the tiles used."""
    points = materialise(fold_copies(df, id_col, features))
    tiles = build_tiles(points, len(features))
    eps = sorted({float(e) for e, _ in configs})
    cfg = [(c, eps.index(float(e)), int(m)) for c, (e, m) in enumerate(configs)]
    most = [max(m for _, at, m in cfg if at == e) for e in range(len(eps))]
    pairs = materialise(tile_pairs(tiles, tiles, metric, reach=max(eps)))
    degrees = materialise(neighbour_degrees(tiles, eps, metric, most, pairs))
    cored = with_tags(tiles, degrees, len(eps))

    # Core rows joined inside their own tile: only component roots leave the tile.
    # Roots are 64-bit ids, so that tag holds integers until clusters are numbered.
    dims = tiles.dims

    def inside_tiles(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.frombuffer(row.ids, dtype=np.int64)
                x, degree = (np.frombuffer(v).reshape(len(ids), n) for v, n in ((row.x, dims), (row.tag, len(eps))))
                roots = np.full((len(ids), len(cfg)), -1, dtype=np.int64)
                for c, e, m in cfg:
                    core = np.flatnonzero(degree[:, e] >= m)
                    if len(core):
                        roots[core, c] = _local_roots(x[core], ids[core], eps[e], metric)
                yield pd.DataFrame([{"tile": row.tile, "tag": roots.tobytes()}])

    roots = materialise(cored.df.select("tile", "ids", "x", "tag").mapInPandas(inside_tiles, "tile int, tag binary"))
    rooted = with_tags(tiles, roots, len(cfg))

    def start_edges(a):
        return {c: set() for c, _, _ in cfg}

    def step_edges(links, a, b, near, far, w_j):
        for c, e, _ in cfg:
            if near > eps[e] * (1 + SLACK):
                continue
            ra, rb = a.tag.view(np.int64)[:, c], b.tag.view(np.int64)[:, c]
            ia, ib = np.flatnonzero(ra >= 0), np.flatnonzero(rb >= 0)
            if not len(ia) or not len(ib):
                continue
            if far <= eps[e] * (1 - SLACK):
                u, v = np.unique(ra[ia]), np.unique(rb[ib])
                links[c].update((int(x), int(v[0])) for x in u)
                links[c].update((int(u[0]), int(y)) for y in v)
                continue
            ia = ia[rows_in_reach(a.x[ia], b.x[ib], eps[e], metric)]
            ib = ib[rows_in_reach(b.x[ib], a.x[ia], eps[e], metric)]
            if not len(ib):
                continue
            # rows closest to the other tile first: most pairs of roots meet in the first strip
            ia = ia[np.argsort(box_reach(a.x[ia], b.x[ib], metric)[0], kind="stable")]
            root_a, at_a = np.unique(ra[ia], return_inverse=True)
            root_b, at_b = np.unique(rb[ib], return_inverse=True)
            met = np.zeros((len(root_a), len(root_b)), dtype=bool)
            for rows, d in distance_strips(a.x[ia], b.x[ib], metric):
                hit_a, hit_b = np.nonzero(d <= eps[e])
                met[at_a[rows][hit_a], at_b[hit_b]] = True
                if met.all():
                    break
            links[c].update((int(root_a[u]), int(root_b[v])) for u, v in np.argwhere(met))

    def finish_edges(links, a):
        rows = [(c, u, v) for c in links for u, v in links[c] if u != v]
        return pd.DataFrame(rows, columns=["config_id", "u", "v"])

    edges = fold_pairs(rooted, rooted, pairs.where(F.col("i") < F.col("j")), start_edges, step_edges, finish_edges,
                       "config_id int, u long, v long")
    return points, label_roots(tiles, pairs, roots, edges, cfg, eps, metric), tiles


def label_roots(tiles: Tiles, pairs: DataFrame, roots: DataFrame, edges: DataFrame, cfg: Sequence[tuple[int, int, int]], eps: Sequence[float],
                metric: str) -> DataFrame:
    """Labels (pid, config_id, cluster) from ``roots`` (tile, tag: per row and configuration the smallest core id reached in
    the tile, -1 off core) and ``edges`` (config_id, u, v) between roots of different tiles; ``cfg`` as (config, eps index, min_samples)."""
    width = len(cfg)

    def list_roots(batches):
        for pdf in batches:
            for tile, blob in zip(pdf["tile"], pdf["tag"]):
                mat = np.frombuffer(blob, dtype=np.int64).reshape(-1, width)
                for c in range(width):
                    found = np.unique(mat[:, c])
                    found = found[found >= 0]
                    yield pd.DataFrame({"tile": np.int32(tile), "config_id": np.int32(c), "node": found})

    nodes = materialise(roots.mapInPandas(list_roots, "tile int, config_id int, node long"))

    comps = connected_components(nodes.select("config_id", F.col("node")).distinct(), edges, ["config_id"])
    # Number clusters by their smallest core id.
    numbers = number_rows(comps.select("config_id", "comp").distinct(), ["comp"], ["config_id"], "cluster")
    named = nodes.join(comps, ["config_id", "node"]).join(
        numbers.select("config_id", "comp", (F.col("cluster") - 1).alias("cluster")), ["config_id", "comp"])
    # Per tile at most one entry per root, so the list is bounded by the tile size.
    lists = named.groupBy("tile").agg(F.collect_list(F.struct("config_id", "node", "cluster")).alias("m"))
    mapped = roots.join(lists, "tile", "left")

    def to_clusters(batches):
        for pdf in batches:
            out = []
            for tile, blob, entries in zip(pdf["tile"], pdf["tag"], pdf["m"]):
                mat = np.frombuffer(blob, dtype=np.int64).reshape(-1, width)
                num = np.full(mat.shape, float(NOISE))
                by = {}
                for r in (entries if entries is not None else []):
                    by.setdefault(r["config_id"], {})[r["node"]] = r["cluster"]
                for c in range(width):
                    col = mat[:, c]
                    if c in by:
                        keys = np.array(sorted(by[c]), dtype=np.int64)
                        vals = np.array([by[c][kk] for kk in sorted(by[c])], dtype=float)
                        core = col >= 0
                        num[core, c] = vals[np.searchsorted(keys, col[core])]
                out.append({"tile": tile, "tag": num.tobytes()})
            yield pd.DataFrame(out)

    clustered = with_tags(tiles, materialise(mapped.mapInPandas(to_clusters, "tile int, tag binary")), width)

    def start_labels(a):
        return np.where(a.tag >= 0, a.tag, np.inf)

    def step_labels(best, a, b, near, far, w_j):
        near_enough = [c for c, e, _ in cfg if near <= eps[e] * (1 + SLACK)]
        if not near_enough:
            return
        reach = max(eps[cfg[c][1]] for c in near_enough)
        open_any = np.flatnonzero((a.tag[:, near_enough] < 0).any(axis=1))
        core_any = np.flatnonzero((b.tag[:, near_enough] >= 0).any(axis=1))
        open_any = open_any[rows_in_reach(a.x[open_any], b.x[core_any], reach, metric)]
        core_any = core_any[rows_in_reach(b.x[core_any], a.x[open_any], reach, metric)]
        if not len(core_any):
            return
        # Distances are the same for all configurations, which differ in who is open and who is core.
        for rows, d in distance_strips(a.x[open_any], b.x[core_any], metric):
            for c in near_enough:
                rest = open_any[rows]
                is_open, core = np.flatnonzero(a.tag[rest, c] < 0), np.flatnonzero(b.tag[core_any, c] >= 0)
                if len(is_open) and len(core):
                    part = d if len(is_open) == len(rest) and len(core) == len(core_any) else d[np.ix_(is_open, core)]
                    found = np.where(part <= eps[cfg[c][1]], b.tag[core_any[core], c][None, :], np.inf).min(axis=1)
                    best[rest[is_open], c] = np.minimum(best[rest[is_open], c], found)

    def finish_labels(best, a):
        lab = np.where(np.isfinite(best), best, NOISE).astype(np.int32)
        return pd.DataFrame({"pid": np.repeat(a.ids, width), "config_id": np.tile(np.arange(width), len(a.ids)),
                             "cluster": lab.ravel()})

    return materialise(fold_pairs(clustered, clustered, pairs, start_labels, step_labels, finish_labels, "pid long, config_id int, cluster int"))


def attach_labels(df: DataFrame, id_col: str, features: Sequence[str], points: DataFrame, labels: DataFrame,
                  tiles: Tiles) -> DataFrame:
    if points.groupBy().agg(F.max("copies")).first()[0] in (None, 1):
        return df.join(labels.withColumnRenamed("pid", id_col), id_col)
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.select("*", *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
    keyed = spread_lookup(rows, points.select(*names, "pid"), names,
                          points.select(*names, F.col("copies").alias("_rows")), tiles.rows)
    n_rows = points.agg(F.sum("copies")).first()[0]
    return spread_lookup(keyed, labels, ["pid"], points.select("pid", F.col("copies").alias("_rows")),
                         n_rows).drop("pid", *names)
