"""Similarity joins, nearest neighbours and sums over all pairs of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsieve.functions.hashing import seeded_digest
from tabsieve.functions.ranking import exact_quantiles, number_rows
from tabsieve.operators import kernels, tiles as tiling
from tabsieve.operators.dbscan import neighbour_degrees
from tabsieve.operators.lines import line_histogram, line_tiles
from tabsieve.operators.scale import whiten
from tabsieve.operators.silhouette import silhouette_points
from tabsieve.operators.tiles import (GROUP_TILES, LEAF_DIMS, SLACK, Tiles, _box_span, block_distance, box_reach, build_tiles, distance_strips,
                                      fold_copies, fold_groups, fold_pairs, leaf_boxes, near_entries, rows_in_reach, shortened, tile_pairs, with_tags)
from tabsieve.session import materialise, spread_join, spread_lookup


def metric_space(df: DataFrame, features: Sequence[str], metric: str, strict: bool = False) -> tuple[DataFrame, list[str], str]:
    """Mahalanobis distance becomes Euclidean distance after whitening once; ``strict`` raises where it is not defined."""
    if metric != "mahalanobis":
        return df, list(features), metric
    return whiten(df, features, prefix="_mh_", strict=strict), [f"_mh_{i}" for i in range(len(features))], "euclidean"


def prepare(df: DataFrame, id_col: str, features: Sequence[str]) -> tuple[DataFrame, Tiles]:
    points = materialise(fold_copies(df, id_col, features))
    return points, build_tiles(points, len(features))


def to_rows(df: DataFrame, id_col: str, features: Sequence[str], points: DataFrame, result: DataFrame) -> DataFrame:
    """Carry a per-point result (keyed by ``pid``) to every row of ``df``: (id, result…)."""
    names = [f"_x{i}" for i in range(len(features))]
    top = points.agg(F.max("copies").alias("m"), F.sum("copies").alias("n")).first()
    if top["m"] in (None, 1):
        return result.withColumnRenamed("pid", id_col)
    values = result.join(points.select("pid", *names), "pid").drop("pid")
    rows = df.select(id_col, *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
    return spread_lookup(rows, values, names, points.select(*names, F.col("copies").alias("_rows")), top["n"]).drop(*names)


def eps_neighbour_counts(df: DataFrame, id_col: str, features: Sequence[str], eps: float,
                         metric: str = "euclidean") -> DataFrame:
    """(id, n_neighbours): rows within ``eps`` (inclusive), the row itself counted."""
    df, features, metric = metric_space(df, features, metric)
    points, tiles = prepare(df, id_col, features)
    degrees = tiles.df.select("tile", "ids").join(neighbour_degrees(tiles, [eps], metric), "tile")

    def unpack(batches):
        for pdf in batches:
            for ids, tag in zip(pdf["ids"], pdf["tag"]):
                yield pd.DataFrame({"pid": np.frombuffer(ids, dtype=np.int64),
                                    "n_neighbours": np.frombuffer(tag).astype(np.int64)})

    return to_rows(df, id_col, features, points, degrees.mapInPandas(unpack, "pid long, n_neighbours long"))


def eps_neighbour_histogram(df: DataFrame, features: Sequence[str], eps: float, metric: str = "euclidean") -> DataFrame:
    """(n_neighbours, n_rows): how many rows have how many rows within ``eps``, themselves counted; summed up inside the tiles."""
    df, features, metric = metric_space(df, features, metric)
    points = materialise(fold_copies(df.withColumn("_none", F.lit(0)), "_none", features).withColumn("pid", F.monotonically_increasing_id()))
    found = line_tiles(points, len(features))
    if found is not None:
        counted = line_histogram(*found, len(features), eps, metric)
        return counted.groupBy("n_neighbours").agg(F.sum("n_rows").alias("n_rows"))
    tiles = build_tiles(points, len(features))
    degrees = tiles.df.select("tile", "w").join(neighbour_degrees(tiles, [eps], metric), "tile")

    def count(batches):
        for pdf in batches:
            for w, tag in zip(pdf["w"], pdf["tag"]):
                found, at = np.unique(np.frombuffer(tag), return_inverse=True)
                yield pd.DataFrame({"n_neighbours": found.astype(np.int64), "n_rows": np.bincount(at, np.frombuffer(w)).astype(np.int64)})

    counted = degrees.mapInPandas(count, "n_neighbours long, n_rows long")
    return counted.groupBy("n_neighbours").agg(F.sum("n_rows").alias("n_rows"))


def eps_pairs(df: DataFrame, id_col: str, features: Sequence[str], eps: float, metric: str = "euclidean") -> DataFrame:
    """(id_a, id_b, distance, copies_a, copies_b) for distinct points, id_a < id_b.

    The output is the join itself. Copies stay folded: two folded points stand for
    ``copies_a * copies_b`` row pairs.
    """
    df, features, metric = metric_space(df, features, metric)
    _, tiles = prepare(df, id_col, features)
    pairs = tile_pairs(tiles, tiles, metric, reach=eps).where(F.col("i") <= F.col("j"))

    def start(a):
        return None

    def step(_, a, b, near, far, w_j):
        found = []
        rows_a = rows_in_reach(a.x, b.x, eps, metric)
        rows_b = rows_in_reach(b.x, a.x[rows_a], eps, metric)
        for part, d in distance_strips(a.x[rows_a], b.x[rows_b], metric):
            r, c = np.nonzero(d <= eps)
            keep_pairs(found, a, b, rows_a[part][r], rows_b[c], d[r, c])
        return pd.concat(found) if found else None

    def keep_pairs(found, a, b, r, c, dist):
        if a.tile == b.tile:
            keep = a.ids[r] < b.ids[c]
            r, c, dist = r[keep], c[keep], dist[keep]
        ia, ib = a.ids[r], b.ids[c]
        swap = ia > ib
        wa, wb = a.w[r].astype(np.int64), b.w[c].astype(np.int64)
        found.append(pd.DataFrame({
            "id_a": np.where(swap, ib, ia), "id_b": np.where(swap, ia, ib), "distance": dist,
            "copies_a": np.where(swap, wb, wa), "copies_b": np.where(swap, wa, wb)}))

    def finish(_, a):
        return None

    return fold_pairs(tiles, tiles, pairs, start, step, finish,
                      "id_a long, id_b long, distance double, copies_a long, copies_b long")


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int | str = 0) -> DataFrame:
    """A repeatable sample of at most ``n`` rows without replacement, by seeded digest order."""
    return (df.withColumn("_d", seeded_digest(seed, id_col)).orderBy("_d", id_col).limit(n).drop("_d"))


def median_pair_distance(df: DataFrame, id_col: str, features: Sequence[str], n: int = 1200, seed: int | str = 0,
                         metric: str = "euclidean") -> float:
    """Median distance over all pairs of a sample of at most ``n`` rows (exact below ``n`` rows)."""
    sample = materialise(sample_rows(df, id_col, n, seed))
    tiles = build_tiles(materialise(sample.select(F.col(id_col).cast("long").alias("pid"), F.lit(1).alias("copies"),
                                                  *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])),
                        len(features))
    pairs = tile_pairs(tiles, tiles, metric).where(F.col("i") <= F.col("j"))

    def start(a):
        return []

    def step(found, a, b, near, far, w_j):
        d = block_distance(a.x, b.x, metric)
        found.append(d[np.triu_indices(len(a.ids), 1)] if a.tile == b.tile else d.ravel())

    def finish(found, a):
        return pd.DataFrame({"distance": np.concatenate(found)}) if found else None

    dist = fold_pairs(tiles, tiles, pairs, start, step, finish, "distance double")
    row = exact_quantiles(dist, [], "distance", [0.5], ["median"]).first()
    return row["median"]


def _nearest(queries: Tiles, refs: Tiles, k: int, metric: str, skip_self: bool) -> DataFrame:
    """Folded k nearest per query point: (pid, w, rank, nid, distance, copies), rank by (distance, id).

    A copy group stands for ``copies`` neighbours, so only as many groups are kept
    as are needed to reach k rows. ``skip_self`` takes one copy of the point itself away.
    """
    pairs = tile_pairs(queries, refs, metric, k=k + (1 if skip_self else 0))

    need = k + (1 if skip_self else 0)

    def start(a):
        n = len(a.ids)
        return {"d": np.full((n, k), np.inf), "id": np.zeros((n, k), dtype=np.int64), "w": np.zeros((n, k)),
                "kth": np.full(n, np.inf), "leaves": leaf_boxes(a.x)}

    def smallest(d, ids, w):
        order = np.lexsort((ids, d), axis=-1)[:, :k]
        return tuple(np.take_along_axis(v, order, axis=1) for v in (d, ids, w))

    def step(best, a, b, near, far, w_j):
        if not (best["kth"] >= near * (1 - SLACK)).any():
            return
        leaves, lo, hi = leaf_boxes(b.x)
        held = np.cumsum([len(rows) for rows in leaves])
        for rows, lo_a, hi_a in zip(*best["leaves"]):
            gap = _box_span(lo_a, hi_a, lo, hi, metric)[0]
            order = np.argsort(gap)
            if not np.isfinite(best["kth"][rows].max()) and len(order) > 1:
                first = 1 + int(np.searchsorted(np.cumsum(np.diff(held, prepend=0)[order]), need))
                offer(best, a, b, rows, [leaves[i] for i in order[:first]])
                order = order[first:]
            order = order[gap[order] <= best["kth"][rows].max() * (1 + SLACK)]
            if len(order):
                offer(best, a, b, rows, [leaves[i] for i in order])

    def offer(best, a, b, rows, leaves):
        cols = np.concatenate(leaves)
        rows = rows[box_reach(a.x[rows], b.x[cols], metric)[0] <= best["kth"][rows] * (1 + SLACK)]
        at_once = max(1, (1 << 17) // len(cols))
        for at in range(0, len(rows), at_once):
            merge(best, a, b, rows[at:at + at_once], cols)

    def merge(best, a, b, rows, cols):
        x, y = a.x[rows], b.x[cols]
        r, c, d = near_entries(x, y, best["kth"][rows], need, metric)
        if not len(r):
            return
        ids, w = b.ids[cols[c]], b.w[cols[c]].copy()
        if skip_self:
            w -= a.ids[rows[r]] == ids
            d = np.where(w > 0, d, np.inf)
        counts = np.bincount(r, minlength=len(rows))
        slot = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        shape = len(rows), counts.max()
        wide = np.full(shape, np.inf), np.zeros(shape, dtype=np.int64), np.zeros(shape)
        for full, found in zip(wide, (d, ids, w)):
            full[r, slot] = found
        met = counts > 0
        rows = rows[met]
        d, ids, w = smallest(*[np.concatenate([best[name][rows], full[met]], axis=1) for name, full in zip(("d", "id", "w"), wide)])
        best["d"][rows], best["id"][rows], best["w"][rows] = d, ids, w
        reached = np.cumsum(np.where(np.isfinite(d), w, 0.0), axis=1) >= k
        first = reached.argmax(axis=1)
        best["kth"][rows] = np.where(reached.any(axis=1), d[np.arange(len(rows)), first], np.inf)

    def finish(best, a):
        r, c = np.nonzero(np.isfinite(best["d"]))
        if not len(r):
            return None
        out = pd.DataFrame({"pid": a.ids[r], "w": a.w[r].astype(np.int64), "slot": (c + 1).astype(np.int32),
                            "nid": best["id"][r, c], "distance": best["d"][r, c],
                            "copies": best["w"][r, c].astype(np.int64)})
        before = out.groupby("pid")["copies"].cumsum() - out["copies"]
        return out[before < k]

    schema = "pid long, w long, slot int, nid long, distance double, copies long"
    if queries.dims > LEAF_DIMS and refs.bytes > tiling.BROADCAST_BYTES:
        # boxes prune next to nothing here, so nearest tiles first is worth less than sending each tile to few tasks
        group = max(1, min(GROUP_TILES, queries.n_tiles // (2 * queries.df.sparkSession.sparkContext.defaultParallelism)))
        return fold_groups(shortened(queries), shortened(refs), pairs, start, step, finish, schema, group)
    return fold_pairs(queries, refs, pairs, start, step, finish, schema)


def knn(df: DataFrame, id_col: str, features: Sequence[str], k: int, other: DataFrame | None = None,
        other_id: str | None = None, metric: str = "euclidean") -> DataFrame:
    """(id, rank, neighbour, distance): exact k nearest rows by (distance, neighbour id).

    Without ``other`` the table is searched against itself and a row is its own
    first neighbour. Every copy of a neighbour counts as a row of its own.
    """
    ref_df, ref_id = (df, id_col) if other is None else (other, other_id or id_col)
    q_points, q_tiles = prepare(df, id_col, features)
    if other is None:
        r_points, r_tiles = q_points, q_tiles
    else:
        r_points, r_tiles = prepare(ref_df, ref_id, features)
    folded = _nearest(q_tiles, r_tiles, k, metric, skip_self=False).select("pid", "nid", "distance")
    if r_points.agg(F.max("copies")).first()[0] == 1:
        best = folded
    else:
        # Spread copy groups over their members, of which at most k can be needed.
        names = [f"_x{i}" for i in range(len(features))]
        member = ref_df.select(F.col(ref_id).cast("long").alias("member"),
                               *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
        first = (member.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("member")))
                 .where(F.col("_r") <= k))
        first = first.join(r_points.select(*names, F.col("pid").alias("nid")), names).select("nid", "member")
        best = spread_join(folded, first, ["nid"]).select("pid", F.col("member").alias("nid"), "distance")
    order = Window.partitionBy("pid").orderBy("distance", "nid")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if q_points.agg(F.max("copies")).first()[0] == 1:
        return to_rows(df, id_col, features, q_points,
                       ranked.select("pid", "rank", F.col("nid").alias("neighbour"), "distance"))
    # k entries per point, carried to all copies of the point as one array
    packed = ranked.groupBy("pid").agg(F.collect_list(F.struct("rank", F.col("nid").alias("neighbour"), "distance")).alias("nn"))
    return to_rows(df, id_col, features, q_points, packed).select(id_col, F.inline("nn"))


def kth_distances(df: DataFrame, id_col: str, features: Sequence[str], k: int, metric: str = "euclidean") -> DataFrame:
    """(id, distance) to the k-th nearest row, the row itself being the first."""
    points, tiles = prepare(df, id_col, features)
    return to_rows(df, id_col, features, points, radii(tiles, k, metric, count_self=True).select("pid", "distance"))


def radii(tiles: Tiles, k: int, metric: str = "euclidean", count_self: bool = False) -> DataFrame:
    """(pid, w, distance) to the k-th nearest row; by default the row itself does not count."""
    near = _nearest(tiles, tiles, k, metric, skip_self=not count_self)
    return near.groupBy("pid", "w").agg(F.max("distance").alias("distance"))


def nearest_distance(queries: Tiles, refs: Tiles, metric: str = "euclidean", skip_self: bool = False) -> DataFrame:
    """(pid, w, nid, distance) of the nearest reference row."""
    return _nearest(queries, refs, 1, metric, skip_self).select("pid", "w", "nid", "distance")


def k_distance_curve(df: DataFrame, id_col: str, features: Sequence[str], k: int, metric: str = "euclidean") -> DataFrame:
    """(position, distance): distances to the k-th neighbour in ascending order."""
    kth = kth_distances(df, id_col, features, k, metric)
    return number_rows(kth, ["distance", id_col], name="position").select("position", "distance")


def tag_tiles(tiles: Tiles, values: DataFrame, column: str) -> Tiles:
    """Attach one double per point (keyed by pid) as the first tag of its tile."""
    def list_ids(batches):
        for pdf in batches:
            for tile, ids in zip(pdf["tile"], pdf["ids"]):
                yield pd.DataFrame({"tile": np.int32(tile), "pid": np.frombuffer(ids, dtype=np.int64)})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid")
        return pd.DataFrame([{"tile": int(rows["tile"].iloc[0]), "tag": rows["v"].to_numpy(dtype=float).tobytes()}])

    located = tiles.df.select("tile", "ids").mapInPandas(list_ids, "tile int, pid long")
    tagged = (located.join(values.select("pid", F.col(column).cast("double").alias("v")), "pid")
              .groupBy("tile").applyInPandas(pack, "tile int, tag binary"))
    out = with_tags(tiles, tagged, 1)
    return Tiles(materialise(out.df), out.dims, out.rows, 1, out.n_tiles)


def ball_counts(queries: Tiles, centres: Tiles, metric: str = "euclidean") -> DataFrame:
    """(pid, w, n_balls): open balls around ``centres`` (radius = first tag) that hold the query row."""
    pairs = tile_pairs(queries, centres, metric, reach_of_b=True)

    def start(a):
        return np.zeros(len(a.ids))

    def step(n, a, b, near, far, w_j):
        rows_b = np.flatnonzero(box_reach(b.x, a.x, metric)[0] <= b.tag[:, 0] * (1 + SLACK))
        for rows, d in distance_strips(a.x, b.x[rows_b], metric):
            n[rows] += (d < b.tag[rows_b, 0][None, :]) @ b.w[rows_b]

    def finish(n, a):
        return pd.DataFrame({"pid": a.ids, "w": a.w.astype(np.int64), "n_balls": n.astype(np.int64)})

    return fold_pairs(queries, centres, pairs, start, step, finish, "pid long, w long, n_balls long")


def kernel_sums(queries: Tiles, refs: Tiles, scale: float, metric: str = "euclidean") -> DataFrame:
    """(pid, w, total): sum over all reference rows of exp(-scale * d^2).

    Where the pairs are many and cells of the kernel's width are few, nodes of cells stand for rows, to some 1e-12 of each sum.
    """
    if metric == "euclidean" and queries.rows * refs.rows > kernels.GRID_FROM:
        read = kernels.grid_sums(queries, refs, scale)
        if read is not None:
            found, far = read.where(F.col("total").isNotNull()).select("pid", "w", "total"), read.where(F.col("total").isNull())
            if far.isEmpty():
                return found
            points = materialise(far.withColumnRenamed("w", "copies").drop("total"))
            return found.unionByName(_pair_sums(build_tiles(points, queries.dims), refs, scale, metric))
    return _pair_sums(queries, refs, scale, metric)


def _pair_sums(queries: Tiles, refs: Tiles, scale: float, metric: str) -> DataFrame:
    # Beyond this distance the kernel is exactly zero in double precision; a tile without a partner keeps its nearest.
    pairs = tile_pairs(queries, refs, metric, reach=math.sqrt(746.0 / scale), nearest_too=True)

    def start(a):
        return np.zeros(len(a.ids))

    def step(acc, a, b, near, far, w_j):
        for rows, d in distance_strips(a.x, b.x, metric):
            acc[rows] += np.exp(-scale * d ** 2) @ b.w

    def finish(acc, a):
        return pd.DataFrame({"pid": a.ids, "w": a.w.astype(np.int64), "total": acc})

    return fold_pairs(queries, refs, pairs, start, step, finish, "pid long, w long, total double")


def silhouette(df: DataFrame, id_col: str, features: Sequence[str], label: str = "cluster",
               metric: str = "euclidean") -> DataFrame:
    """One row with the exact mean silhouette of a labelled table."""
    points = materialise(fold_copies(df, id_col, features, [label]))
    tiles = build_tiles(points, len(features))
    labels = points.select("pid", F.lit(0).alias("config_id"), F.col("_t0").cast("int").alias("cluster"))
    return silhouette_points(tiles, labels, metric).select("silhouette")
