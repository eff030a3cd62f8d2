"""Labels of a whole grid of DBSCAN configurations from one spanning forest per ``min_samples``.

With core distances in hand, the distance that decides whether two rows are joined as core rows is the largest of
theirs and of both core distances, for every eps alike. A spanning forest of least weight keeps, cut at any eps,
the components of all pairs within eps. Forests of the parts of a graph together do the same for the whole, so
each tile and each pair of tiles sends its forest, and no forest is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.dbscan import label_roots
from tabsieve.operators.tiles import (SLACK, Tiles, block_distance, box_reach, build_tiles, distance_strips, fold_copies, fold_pairs, rows_in_reach,
                                      tile_pairs, with_tags)
from tabsieve.session import materialise


def core_distances(tiles: Tiles, min_samples: Sequence[int], metric: str, reach: float, pairs: DataFrame) -> DataFrame:
    """(tile, tag): per row and entry of ``min_samples`` the distance within which that many rows lie, itself and copies included.

    Infinite beyond ``reach``. A row keeps at most as many neighbours as the largest entry asks for.
    """
    most = max(min_samples)

    def start(a):
        return {"d": np.full((len(a.ids), most), np.inf), "w": np.zeros((len(a.ids), most)), "bound": np.full(len(a.ids), reach)}

    def step(held, a, b, near, far, w_j):
        ia = np.flatnonzero(box_reach(a.x, b.x, metric)[0] <= held["bound"] * (1 + SLACK))
        if not len(ia):
            return
        ib = rows_in_reach(b.x, a.x[ia], reach, metric)
        for rows, d in distance_strips(a.x[ia], b.x[ib], metric):
            own, w = ia[rows], np.broadcast_to(b.w[ib], d.shape)
            if d.shape[1] > most:
                at = np.argpartition(d, most - 1, axis=1)[:, :most]
                d, w = np.take_along_axis(d, at, 1), np.take_along_axis(w, at, 1)
            d, w = np.hstack([held["d"][own], np.where(d <= reach, d, np.inf)]), np.hstack([held["w"][own], w])
            at = np.argsort(d, axis=1, kind="stable")[:, :most]
            d, w = np.take_along_axis(d, at, 1), np.take_along_axis(w, at, 1)
            held["d"][own], held["w"][own] = d, w
            held["bound"][own] = np.minimum(reach, _at_weight(d, w, most))

    def finish(held, a):
        return pd.DataFrame([{"tile": a.tile, "tag": np.stack([_at_weight(held["d"], held["w"], m) for m in min_samples], axis=1).tobytes()}])

    return fold_pairs(tiles, tiles, pairs, start, step, finish, "tile int, tag binary")


def _at_weight(d: np.ndarray, w: np.ndarray, m: int) -> np.ndarray:
    """Per row the first of the ascending distances at which the weights reach ``m``."""
    enough = np.cumsum(np.where(np.isfinite(d), w, 0), axis=1) >= m
    return np.where(enough.any(axis=1), d[np.arange(len(d)), enough.argmax(axis=1)], np.inf)


class _Joined:
    """Union-find over small whole numbers; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        root = np.array(self.parent)
        while (root[root] != root).any():
            root = root[root]
        return root


def spanning_forest(weights: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A least spanning forest over rows and columns of ``weights`` (infinite: no edge) as (row, column, weight).

    ``same``: rows and columns are the same vertices. Rounds join every component by its lightest edge.
    """
    n_rows, n_cols = weights.shape
    open_ = weights.copy()
    shift = 0 if same else n_rows
    joined, found = _Joined(n_rows if same else n_rows + n_cols), []
    while True:
        root = joined.roots()
        open_[root[:n_rows][:, None] == root[shift:shift + n_cols][None, :]] = np.inf
        col, row = open_.argmin(axis=1), open_.argmin(axis=0)
        i = np.concatenate([np.arange(n_rows), row])
        j = np.concatenate([col, np.arange(n_cols)])
        w, comp = open_[i, j], np.concatenate([root[:n_rows], root[shift:shift + n_cols]])
        order = np.lexsort((w, comp))
        first = order[np.concatenate([[True], comp[order][1:] != comp[order][:-1]])]
        first = first[np.isfinite(w[first])]
        if not len(first):
            break
        for k in first[np.argsort(w[first], kind="stable")].tolist():
            if joined.join(int(i[k]), int(j[k]) + shift):
                found.append((i[k], j[k], w[k]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, w = map(np.array, zip(*found))
    return i.astype(np.int64), j.astype(np.int64), w


def label_grid(df: DataFrame, id_col: str, features: Sequence[str], configs: Sequence[tuple[float, int]],
               metric: str = "euclidean") -> tuple[DataFrame, DataFrame, Tiles]:
    """``dbscan.label_points`` for a whole grid: as many forests as there are values of ``min_samples``, cut at every eps.

    A tile pair is compared once for all configurations, for core distances, for forests and for border rows.
    """
    points = materialise(fold_copies(df, id_col, features))
    tiles = build_tiles(points, len(features))
    eps, least = sorted({float(e) for e, _ in configs}), sorted({int(m) for _, m in configs})
    cfg = [(c, eps.index(float(e)), int(m)) for c, (e, m) in enumerate(configs)]
    of = {m: sorted((eps[e], c) for c, e, n in cfg if n == m) for m in least}
    reach, width, dims = max(eps), len(cfg), tiles.dims
    pairs = materialise(tile_pairs(tiles, tiles, metric, reach=reach))
    cores = materialise(core_distances(tiles, least, metric, reach, pairs))
    cored = with_tags(tiles, cores, len(least))

    def inside_tiles(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.frombuffer(row.ids, dtype=np.int64)
                x, core = (np.frombuffer(v).reshape(len(ids), n) for v, n in ((row.x, dims), (row.tag, len(least))))
                roots, d = np.full((len(ids), width), -1, dtype=np.int64), block_distance(x, x, metric)
                for k, m in enumerate(least):
                    on = np.flatnonzero(core[:, k] <= reach)
                    if not len(on):
                        continue
                    weights = np.maximum(np.maximum(d[np.ix_(on, on)], core[on, k][:, None]), core[on, k][None, :])
                    weights[weights > reach] = np.inf
                    np.fill_diagonal(weights, np.inf)
                    i, j, w = spanning_forest(weights, True)
                    order, at, joined = np.argsort(w, kind="stable"), 0, _Joined(len(on))
                    for limit, c in of[m]:
                        while at < len(order) and w[order[at]] <= limit:
                            joined.join(int(i[order[at]]), int(j[order[at]]))
                            at += 1
                        is_core = core[on, k] <= limit
                        roots[on[is_core], c] = ids[on[joined.roots()[is_core]]]
                yield pd.DataFrame([{"tile": row.tile, "tag": roots.tobytes()}])

    roots = materialise(cored.df.select("tile", "ids", "x", "tag").mapInPandas(inside_tiles, "tile int, tag binary"))

    # The tag of the edge pass holds core distances and roots side by side, the roots as the bits of 64-bit integers.
    def beside(batches):
        for pdf in batches:
            for tile, core, root in zip(pdf["tile"], pdf["tag"], pdf["root"]):
                core, root = np.frombuffer(core).reshape(-1, len(least)), np.frombuffer(root).reshape(-1, width)
                yield pd.DataFrame([{"tile": np.int32(tile), "tag": np.hstack([core, root]).tobytes()}])

    joined_tags = cores.join(roots.withColumnRenamed("tag", "root"), "tile").mapInPandas(beside, "tile int, tag binary")
    both = with_tags(tiles, materialise(joined_tags), len(least) + width)

    def start(a):
        return {c: set() for c in range(width)}

    def step(links, a, b, near, far, w_j):
        for k, m in enumerate(least):
            ia, ib = np.flatnonzero(a.tag[:, k] <= reach), np.flatnonzero(b.tag[:, k] <= reach)
            ia = ia[rows_in_reach(a.x[ia], b.x[ib], reach, metric)]
            ib = ib[rows_in_reach(b.x[ib], a.x[ia], reach, metric)]
            if not len(ib):
                continue
            weights = np.maximum(np.maximum(block_distance(a.x[ia], b.x[ib], metric), a.tag[ia, k][:, None]), b.tag[ib, k][None, :])
            weights[weights > reach] = np.inf
            i, j, w = spanning_forest(weights, False)
            for limit, c in of[m]:
                cut = w <= limit
                u = a.tag[ia[i[cut]], len(least) + c].view(np.int64)
                v = b.tag[ib[j[cut]], len(least) + c].view(np.int64)
                links[c].update(zip(u.tolist(), v.tolist()))

    def finish(links, a):
        rows = [(c, u, v) for c in links for u, v in links[c] if u != v]
        return pd.DataFrame(rows, columns=["config_id", "u", "v"])

    edges = fold_pairs(both, both, pairs.where(F.col("i") < F.col("j")), start, step, finish, "config_id int, u long, v long")
    return points, label_roots(tiles, pairs, roots, edges, cfg, eps, metric), tiles
