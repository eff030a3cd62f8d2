import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import dbscan as slow_dbscan
from brute import distances, silhouette
from tabsieve.operators import neighbours, proximity, tiles
from tabsieve.operators.components import connected_components
from tabsieve.operators.dbscan import dbscan
from tabsieve.operators.silhouette import (cluster_cells, cluster_summaries, clusters_to_open, label_tiles, pairs_to_open,
                                           silhouette_points)
from tabsieve.operators.tiles import LEAF_ROWS, block_distance, build_tiles, leaf_boxes, near_entries


def frame(spark, x, offset=0):
    cols = [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i + offset, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols)), cols


def skewed_points(seed=3, dims=2):
    """A third exact copies, a third one dense ball, a third spread out."""
    rng = np.random.default_rng(seed)
    copies = np.tile(rng.normal(size=(1, dims)) + 4, (150, 1))
    ball = rng.normal(scale=0.02, size=(150, dims))
    spread = rng.uniform(-3, 6, size=(150, dims))
    x = np.concatenate([copies, ball, spread])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("metric,dims", [("euclidean", 2), ("manhattan", 3)])
def test_dbscan_matches_scan_order(spark, metric, dims):
    x = skewed_points(dims=dims)
    df, cols = frame(spark, x)
    configs = [(0.4, 4), (0.8, 4), (0.8, 12)]
    rows = dbscan(df, "id", cols, configs, metric).select("config_id", "id", "cluster").collect()
    for c, (eps, m) in enumerate(configs):
        got = np.array([r["cluster"] for r in sorted((r for r in rows if r["config_id"] == c), key=lambda r: r["id"])])
        assert (got == slow_dbscan(x, eps, m, metric)).all()


def test_border_row_joins_lowest_cluster(spark):
    x = np.array([[0.0], [0.1], [0.2], [0.3], [1.0], [1.7], [1.8], [1.9], [2.0]])
    df, cols = frame(spark, x)
    got = {r["id"]: r["cluster"] for r in dbscan(df, "id", cols, [(0.71, 4)]).collect()}
    assert [got[i] for i in range(9)] == list(slow_dbscan(x, 0.71, 4)) and got[4] == 0


def test_labels_do_not_depend_on_row_order(spark):
    x = skewed_points(5)
    df, cols = frame(spark, x)
    a = {r["id"]: r["cluster"] for r in dbscan(df, "id", cols, [(0.5, 5)]).collect()}
    b = {r["id"]: r["cluster"] for r in dbscan(df.orderBy(F.rand(1)), "id", cols, [(0.5, 5)]).collect()}
    assert a == b


def test_neighbour_counts_pairs_and_knn(spark):
    x = skewed_points(9)
    df, cols = frame(spark, x)
    d = distances(x, x)
    got = {r["id"]: r["n_neighbours"] for r in neighbours.eps_neighbour_counts(df, "id", cols, 0.3).collect()}
    assert [got[i] for i in range(len(x))] == list((d <= 0.3).sum(1))
    pairs = neighbours.eps_pairs(df, "id", cols, 0.3).agg(F.sum(F.col("copies_a") * F.col("copies_b"))).first()[0]
    _, copies = np.unique(x, axis=0, return_counts=True)
    assert pairs + (copies * (copies - 1) // 2).sum() == (np.triu(d <= 0.3, 1)).sum()
    near = neighbours.knn(df, "id", cols, 4).collect()
    order = np.lexsort((np.tile(np.arange(len(x)), (len(x), 1)), d))[:, :4]
    best = {(r["id"], r["rank"]): r["neighbour"] for r in near}
    assert len(near) == 4 * len(x) and all(best[i, k + 1] == order[i, k] for i in range(len(x)) for k in range(4))


def test_knn_other_table_and_high_dimensions(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 40)), np.repeat(rng.normal(size=(45, 40)), 2, axis=0)
    (da, cols), (db, _) = frame(spark, a), frame(spark, b)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.knn(da, "id", cols, 3, db, "id").collect()}
    d = distances(a, b)
    order = np.lexsort((np.tile(np.arange(90), (60, 1)), d))[:, :3]
    assert all(got[i, k + 1] == order[i, k] for i in range(60) for k in range(3))


def test_silhouette_with_copies(spark):
    x = skewed_points(2)
    df, cols = frame(spark, x)
    label = slow_dbscan(x, 0.5, 5)
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, cluster int")
    got = neighbours.silhouette(df.join(rows, "id"), "id", cols).first()[0]
    d = distances(x, x)
    want = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        want.append((b - a) / max(a, b) if max(a, b) else 0.0)
    assert got == pytest.approx(np.mean(want)) and silhouette(x[:50], np.arange(50) % 2) is not None
    assert neighbours.silhouette(df.withColumn("cluster", F.lit(0)), "id", cols).first()[0] == -1.0


def test_components_of_a_long_chain(spark):
    edges = spark.range(199).select(F.lit(0).alias("g"), F.col("id").alias("u"), (F.col("id") + 1).alias("v")).where("u != 99")
    nodes = spark.range(200).select(F.lit(0).alias("g"), F.col("id").alias("node"))
    got = {r["node"]: r["comp"] for r in connected_components(nodes, edges, ["g"]).collect()}
    assert all(got[i] == (0 if i < 100 else 100) for i in range(200))


def test_ball_metrics_against_brute_force(spark):
    rng = np.random.default_rng(4)
    real, syn = np.round(rng.normal(size=(90, 2)), 1), np.round(rng.normal(0.4, size=(70, 2)), 1)
    (dr, cols), (ds, _) = frame(spark, real), frame(spark, syn)
    got = {r["metric"]: r["value"] for r in proximity.prdc(proximity.Pair(dr, ds, "id", "id", cols), 5).collect()}
    rr, ss, rs = distances(real, real), distances(syn, syn), distances(real, syn)
    kr, ks = np.sort(rr, 1)[:, 5], np.sort(ss, 1)[:, 5]
    inside = rs < kr[:, None]
    assert got["precision"] == pytest.approx(inside.any(0).mean())
    assert got["recall"] == pytest.approx((rs < ks[None, :]).any(1).mean())
    assert got["density"] == pytest.approx(inside.sum(0).mean() / 5)
    assert got["coverage"] == pytest.approx((rs.min(1) < kr).mean())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_silhouette_opens_only_near_clusters(spark, metric):
    rng = np.random.default_rng(8)
    centres = rng.uniform(-40, 40, size=(30, 2))
    label = np.repeat(np.arange(30), 60)
    x = np.round(centres[label] + rng.normal(scale=0.6, size=(1800, 2)), 1)
    labellings = {0: label, 3: np.where(rng.uniform(size=1800) < 0.05, -1, label), 5: np.zeros(1800, dtype=int), 9: np.where(label == 4, np.arange(1800) + 100, label)}
    df, cols = frame(spark, x)
    points, _ = neighbours.prepare(df, "id", cols)
    tiles = build_tiles(points, 2, max_tile_rows=128)
    first = {}
    for i, r in enumerate(x):
        first.setdefault(tuple(r), i)
    # Copies are folded before, so each point has the cluster of its first copy.
    same = np.array([first[tuple(r)] for r in x])
    labellings = {c: v[same] for c, v in labellings.items()}
    rows = [(int(i), c, int(v[i])) for c, v in labellings.items() for i in sorted(set(same))]
    labels = spark.createDataFrame(rows, "pid long, config_id int, cluster int")
    got = {r["config_id"]: r["silhouette"] for r in silhouette_points(tiles, labels, metric).collect()}
    d = distances(x, x, metric)
    for c, v in labellings.items():
        if len(set(v)) == 1:
            assert got[c] == -1.0
            continue
        kinds = sorted(set(v))
        sums = np.stack([d[:, v == k].sum(axis=1) for k in kinds], axis=1)
        n, own, at = np.array([(v == k).sum() for k in kinds]), np.searchsorted(kinds, v), np.arange(len(v))
        inner, mean = sums[at, own] / np.maximum(n[own] - 1, 1), sums / n
        mean[at, own] = np.inf
        outer = mean.min(axis=1)
        assert got[c] == pytest.approx(np.mean(np.where(n[own] == 1, 0.0, (outer - inner) / np.maximum(inner, outer))))
    # The plain labelling: most clusters stay closed, and so do most tile pairs.
    one = labels.where("config_id = 0")
    marked = label_tiles(tiles, one, 1)
    cells = cluster_cells(marked)
    opened = clusters_to_open(marked, cluster_summaries(cells, 2), metric)
    sizes = [len(r["cluster"]) for r in opened.collect()]
    assert len(sizes) == tiles.df.count() >= 14 and np.mean(sizes) < 15
    assert pairs_to_open(opened, cells).count() < 0.6 * len(sizes) ** 2


def test_silhouette_of_no_rows(spark):
    df, cols = frame(spark, np.zeros((1, 2)))
    assert neighbours.silhouette(df.limit(0).withColumn("cluster", F.lit(0)), "id", cols).count() == 0


@pytest.mark.parametrize("dims", [2, 24])
def test_near_entries_hold_the_nearest_and_their_ties(dims):
    rng = np.random.default_rng(5)
    y = np.round(rng.normal(size=(200, dims)), 1) + 1e6
    y[100:] = y[:100]  # every distance twice
    x, want = y[:20] + 0.25, np.full(20, np.inf)
    d = block_distance(x, y)
    for reach in (want, np.sort(d, axis=1)[:, 2]):
        r, c, got = near_entries(x, y, reach, 4, "euclidean")
        assert (got == d[r, c]).all() and len(r) < 0.2 * d.size
        for i in range(20):
            limit = min(reach[i], np.sort(d[i])[3])
            assert set(np.flatnonzero(d[i] <= limit)) <= set(c[r == i])


def test_leaves_of_a_block_are_small_and_hold_every_row_once():
    x = np.random.default_rng(6).normal(size=(1000, 3))
    leaves, lo, hi = leaf_boxes(x)
    assert max(map(len, leaves)) <= LEAF_ROWS and (np.sort(np.concatenate(leaves)) == np.arange(1000)).all()
    assert all((x[rows] >= a).all() and (x[rows] <= b).all() for rows, a, b in zip(leaves, lo, hi))
    assert np.prod(hi - lo, axis=1).sum() < 0.5 * np.prod(x.max(axis=0) - x.min(axis=0))


def test_knn_in_many_columns_sends_tiles_to_groups(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(900, 12)).astype(np.float32).astype(float)
    x[::7] = x[1]
    x[100:500] = rng.normal(size=(400, 12))  # these need eight bytes a value
    df, cols = frame(spark, x)
    want = sorted(map(tuple, neighbours.knn(df, "id", cols, 4).collect()))
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(neighbours, "fold_pairs", None)
    assert sorted(map(tuple, neighbours.knn(df, "id", cols, 4).collect())) == want
    other, _ = frame(spark, x[:300] + 0.5, offset=5000)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.knn(df, "id", cols, 2, other, "id").collect()}
    d = distances(x, x[:300] + 0.5)
    assert [got[i, 1] - 5000 for i in range(900)] == [int(np.lexsort((np.arange(300), r))[0]) for r in d]


def test_tiles_travel_short_only_where_that_is_exact(spark):
    x = np.array([[0.5, 1.0]] * 300 + [[0.1, 1e300]])
    df, cols = frame(spark, x)
    _, built = neighbours.prepare(df, "id", cols)
    rows = {r["tile"]: r for r in tiles.shortened(built).df.collect()}
    for r in built.df.collect():
        block = tiles._block(r["tile"], *(rows[r["tile"]][c] for c in ("ids", "x", "w", "tag")), 2, 0)
        assert block.x.tobytes() == r["x"]
