import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import distances
from tabsieve.operators import lines, neighbours, tiles


def histogram(counts):
    return dict(zip(*(v.tolist() for v in np.unique(counts, return_counts=True))))


def found(spark, x, eps, metric):
    cols = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    return {r["n_neighbours"]: r["n_rows"] for r in neighbours.eps_neighbour_histogram(df, cols, eps, metric).collect()}


@pytest.mark.parametrize("metric,dims,axis", [("euclidean", 3, 1), ("manhattan", 2, 0), ("euclidean", 2, 1)])
def test_counts_on_lines_are_those_of_all_pairs(spark, monkeypatch, metric, dims, axis):
    rng = np.random.default_rng(dims)
    x = rng.integers(0, 4, size=(2500, dims)) / 4.0
    # values along the lines: some at distances of exactly the limit, some copies, some close together, some free
    x[:, axis] = np.concatenate([rng.integers(0, 20, 500) / 4.0, 3 + rng.uniform(0, 1e-13, 300), rng.uniform(0, 5, 1700)])
    monkeypatch.setattr(lines, "MIN_LINE_ROWS", 8)
    monkeypatch.setattr(lines, "MIN_PIECE_ROWS", 40)
    monkeypatch.setattr(neighbours, "build_tiles", None)
    for eps in (0.25, 0.6):
        want = histogram((distances(x, x, metric) <= eps).sum(axis=1))
        assert found(spark, x, eps, metric) == want
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 1000)
    assert found(spark, x, eps, metric) == want


def test_pieces_of_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "MIN_PIECE_ROWS", 100)
    df = spark.range(3000).select((F.col("id") % 3).cast("double").alias("_x0"), F.rand(1).alias("_x1"), F.lit(2).alias("copies"))
    found, axis = lines.line_tiles(df, 2)
    rows = found.df.collect()
    assert axis == 1 and sum(r["n"] for r in rows) == 3000 and sum(r["weight"] for r in rows) == 6000 and max(r["n"] for r in rows) <= 100
    assert sorted(r["tile"] for r in rows) == list(range(found.n_tiles)) and all(r["lo"][0] == r["hi"][0] for r in rows)
    for r in rows:
        assert (np.diff(np.frombuffer(r["x"])) >= 0).all() and np.frombuffer(r["x"])[0] == r["lo"][1]


def test_rows_that_share_no_lines_keep_their_tiles(spark):
    free = spark.range(500).select(F.rand(1).alias("_x0"), F.rand(2).alias("_x1"), F.lit(1).alias("copies"))
    assert lines.line_tiles(free, 2) is None and lines.line_tiles(free.limit(0), 2) is None
    holes = spark.range(500).select((F.col("id") % 2).cast("double").alias("_x0"), F.when(F.col("id") > 5, F.rand(2)).otherwise(float("nan")).alias("_x1"), F.lit(1).alias("copies"))
    assert lines.line_tiles(holes, 2) is None and lines.line_tiles(holes.where("_x1 < 2"), 2) is not None
