"""Spanning forests cut at every eps against one DBSCAN run per configuration and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import dbscan, forest, search
from brute import dbscan as dbscan_labels

EPS, LEAST = (0.1, 0.25, 0.5, 1.0), (1, 3, 4, 9)


def table(spark, seed=3, n=700):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, 0.25, (n // 4, 2)) for c in ((0, 0), (1.2, 0), (3, 3))] + [rng.uniform(-2, 5, (n - 3 * (n // 4), 2))])
    x = np.vstack([x, np.repeat(x[:5], 6, axis=0), np.round(x[:60], 1)])
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_grid_labels_equal_brute_force(spark, metric):
    x, df = table(spark)
    configs = [(e, m) for e in EPS for m in LEAST]
    points, labels, tiles = forest.label_grid(df, "id", ["a", "b"], configs, metric)
    assert tiles.n_tiles > 1
    got = dbscan.attach_labels(df, "id", ["a", "b"], points, labels, tiles)
    by = {}
    for r in got.select("config_id", "id", "cluster").collect():
        by.setdefault(r["config_id"], {})[r["id"]] = r["cluster"]
    for c, (e, m) in enumerate(configs):
        want = dbscan_labels(x, e, m, metric)
        assert [by[c][i] for i in range(len(x))] == list(want), (e, m)


def test_forest_cut_keeps_components():
    rng = np.random.default_rng(0)
    for same in (True, False):
        for _ in range(30):
            d = rng.integers(1, 6, (12, 12 if same else 9)).astype(float)
            if same:
                d = np.minimum(d, d.T)
                np.fill_diagonal(d, np.inf)
            d[d > 4] = np.inf
            i, j, w = forest.spanning_forest(d, same)
            for cut in (1, 2, 3, 4):
                def components(edges):
                    joined = forest._Joined(sum(d.shape))
                    for u, v in edges:
                        joined.join(int(u), int(v) + (0 if same else d.shape[0]))
                    return joined.roots().tolist()
                assert components(zip(i[w <= cut], j[w <= cut])) == components(np.argwhere(d <= cut))
            assert (w <= 4).all() and len(i) < sum(d.shape)


def test_default_grid_holds_every_configuration(spark):
    _, df = table(spark, n=160)
    out = search.grid_search(df, "id", ["a", "b"])
    assert out.count() == 3 * len(search.DEFAULT_EPS) * len(search.DEFAULT_MIN_SAMPLES) == out.select("metric", "eps", "min_samples").distinct().count()
    one = search.grid_search(df, "id", ["a", "b"], (0.3,), (5,), ("manhattan",)).first()
    same = out.where((F.col("metric") == "manhattan") & (F.col("eps") == 0.3) & (F.col("min_samples") == 5)).first()
    assert one["num_clusters"] == same["num_clusters"] and one["silhouette_score"] == pytest.approx(same["silhouette_score"], abs=1e-12)


def test_grid_of_no_rows_and_of_one_row(spark):
    _, df = table(spark, n=8)
    for n in (0, 1):
        points, labels, _ = forest.label_grid(df.limit(n), "id", ["a", "b"], [(0.5, 1), (0.5, 2)])
        assert sorted(r["cluster"] for r in labels.collect()) == [-1, 0][:2 * n]


def test_grid_states_where_mahalanobis_is_undefined(spark):
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=80), rng.normal(size=80)
    rows = spark.createDataFrame([(i, float(u), float(2 * u + 1), float(v)) for i, (u, v) in enumerate(zip(a, b))], "id long, a double, twice double, b double")
    got = search.grid_search(rows, "id", ["a", "twice"], (0.2, 0.4), (3,), ("euclidean", "mahalanobis"), algorithms=("auto", "brute"))
    measures = ["num_clusters", "percentage_outliers", "silhouette_score"]
    held = {m: [[r[c] is None for c in measures] for r in got.where(F.col("metric") == m).collect()] for m in ("euclidean", "mahalanobis")}
    assert held == {"euclidean": [[False] * 3] * 4, "mahalanobis": [[True] * 3] * 4}
    assert {r["metric"] for r in search.rank_configurations(got, 0.0, top_n=50).collect()} <= {"euclidean"}
    assert {r["metric"] for r in search.rank_by_noise(got, 0.0, top_n=50).collect()} == {"euclidean"}
    free = search.grid_search(rows, "id", ["a", "b"], (0.4,), (3,), ("mahalanobis",)).collect()
    assert len(free) == 1 and free[0]["num_clusters"] is not None
