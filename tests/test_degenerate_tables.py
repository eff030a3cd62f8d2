"""Tables whose rows repeat or fall into one cluster."""

import numpy as np
from brute import distances
from pyspark.sql import functions as F

from tabsieve.operators import neighbours, proximity, tiles
from tabsieve.operators.diagnose import silhouette_squared
from tabsieve.operators.generate import split_train_holdout
from tabsieve.operators.proximity import scaled_pair
from tabsieve.queries import QUERIES


def test_every_copy_of_a_row_gets_its_nearest_row(spark):
    real = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, 1.0, 0.0)], "id long, a double, b double")
    syn = spark.createDataFrame([(7, 0.0, 0.1), (8, 1.0, 1.0), (9, 1.0, 1.0)], "id long, a double, b double")
    got = scaled_pair(real, syn, "id", "id", ["a", "b"]).real_rows_to_syn().orderBy("pid").collect()
    assert [(r["pid"], r["nid"], round(r["distance"], 6)) for r in got] == [(1, 7, 0.1), (2, 7, 0.1), (3, 8, 0.0), (4, 8, 1.0)]


def test_squared_silhouette_of_one_label_is_undefined(spark):
    df = spark.range(6).select(F.col("id").cast("double").alias("a"), F.lit(0).alias("cluster"))
    assert silhouette_squared(df, ["a"]) is None and silhouette_squared(df.limit(0), ["a"]) is None
    assert silhouette_squared(df.withColumn("cluster", (F.col("a") > 2).cast("int")), ["a"]) > 0


def test_sanitiser_query_without_an_admissible_configuration(spark, tmp_path):
    part = spark.range(12).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"),
                                  F.lit("t").alias("p_type"), F.lit(3).alias("p_size"), F.lit(9.5).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["d6_capped_sanitiser"](spark, str(tmp_path))
    assert got.columns == part.columns and got.count() == 0


def test_share_of_a_split_is_taken_exactly(spark):
    for n, want in ((90, 63), (91, 63), (10, 7)):
        parts = split_train_holdout(spark.range(n), "id")
        assert parts.where("part = 'train'").count() == want and parts.count() == n


def test_kernel_discrepancy_compares_no_pairs_in_a_narrow_box(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.random((70, 2)), rng.random((40, 2)) * 1.2 - 0.1
    x[:20] = x[0]  # copies

    def frame(m):
        return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, a double, b double")

    pair = proximity.Pair(frame(x), frame(y), "id", "id", ["a", "b"])
    for gamma in (1.0, 9.0):
        k = [np.exp(-gamma * distances(p, q) ** 2).mean() for p, q in ((x, x), (y, y), (x, y))]
        want = k[0] + k[1] - 2 * k[2]
        with monkeypatch.context() as m:
            m.setattr(proximity, "MAX_MONOMIALS", 0)
            assert abs(proximity.mmd_rbf(pair, gamma).first()[0] - want) < 1e-13
            m.undo()
            m.setattr(proximity, "kernel_sums", None)
            assert abs(proximity.mmd_rbf(pair, gamma).first()[0] - want) < 1e-13
    assert proximity._kernel_degree(1e4, 2) is None and proximity._kernel_degree(1.0, 30) is None


def test_neighbour_counts_send_a_tile_once_to_a_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((1500, 2)), np.full((40, 2), 0.5)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    want = np.unique((distances(x, x) <= 0.2).sum(1), return_counts=True)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    for size in (2, 3):
        monkeypatch.setattr(tiles, "GROUP_TILES", size)
        got = {r["n_neighbours"]: r["n_rows"] for r in neighbours.eps_neighbour_histogram(df, ["a", "b"], 0.2).collect()}
        assert got == dict(zip(*[v.tolist() for v in want]))
    per_row = {r["id"]: r["n_neighbours"] for r in neighbours.eps_neighbour_counts(df, "id", ["a", "b"], 0.2).collect()}
    assert [per_row[i] for i in range(len(x))] == (distances(x, x) <= 0.2).sum(1).tolist()
