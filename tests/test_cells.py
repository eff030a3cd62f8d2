import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import attack
from tabsieve.operators.cells import count_cells, exact_thresholds, forest_predictions, grow
from tabsieve.queries import attacks


def test_thresholds_are_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(size=30_000), 3)
    rows = spark.createDataFrame([(float(v), float(v > 1)) for v in x], "x double, few double")
    assert exact_thresholds(rows, "few") == [0.5]
    got = exact_thresholds(rows, "x")
    assert len(got) == 31 and not np.isin(got, x).any()
    below = np.array([(x <= t).sum() for t in got])
    assert np.abs(below - len(x) * np.arange(1, 32) / 32).max() <= np.unique(x, return_counts=True)[1].max() / 2
    holes = spark.createDataFrame([(1.0,), (float("nan"),), (1.0,)], "x double")
    assert exact_thresholds(holes, "x") == [1.0] and exact_thresholds(holes.where("x = 1"), "x") == []


def test_forest_of_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(6000, 3))
    rows = spark.createDataFrame([(*map(float, r), float((r[0] > 0.5) + 2 * (r[1] > 0.25))) for r in x], "a double, b double, c double, label double")
    features = ["a", "b", "c"]
    cuts = [exact_thresholds(rows, c, 8) for c in features]
    cells = count_cells(rows, features, cuts)
    got = forest_predictions(cells, cells, 3, 4, 20, 8)
    assert got.agg(F.sum("n")).first()[0] == 6000
    assert got.where("label = prediction").agg(F.sum("n")).first()[0] > 5700
    assert forest_predictions(cells, cells.limit(0), 3, 4, 3, 8).count() == 0
    one = grow(np.array([[0], [1], [2]]), np.array([[3.0, 0], [0, 2], [1, 1]]), np.array([[0], [1], [2], [1]]), 5, 4, rng)
    assert one.tolist() == [[1, 0], [0, 1], [0.5, 0.5], [0, 1]]


def test_attacks_fit_on_every_row(spark, monkeypatch, tmp_path):
    rows = [(s, float(i % 50), float(i), float(i % 7), "NAR"[i % 3]) for s, n in (("F", 5000), ("O", 300)) for i in range(n)]
    spark.createDataFrame(rows, "l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    fitted, fit = [], attack._attacked

    def spy(name, train, *more):
        fitted.append((name, train.count()))
        return fit(name, train, *more)

    monkeypatch.setattr(attack, "_attacked", spy)
    got = attacks.attribute(spark, str(tmp_path)).collect()
    assert fitted == [("logreg", 5000), ("rf", 5000)]
    assert [r["error"] for r in got] == [None, None] and all(0 <= r["acc"] <= 1 for r in got)
    fitted.clear()
    assert attacks.sweep(spark, str(tmp_path)).where("not degenerate and fit_error is null").count() == 2
    assert fitted == [("logreg", 5000), ("rf", 5000)]


def test_more_cells_than_a_task_holds_take_every_row_to_mllib(spark, monkeypatch):
    from tabsieve.operators import cells
    rows = spark.range(600).select((F.col("id") % 40).cast("double").alias("x"), F.when(F.col("id") % 40 < 20, "lo").otherwise("hi").alias("s"))
    want = attack.attribute_inference(rows, rows, "s", ("rf", "xgb"), trees=5, depth=4).collect()
    monkeypatch.setattr(cells, "MAX_CELL_NUMBERS", 10)
    got = attack.attribute_inference(rows, rows, "s", ("rf", "xgb"), trees=5, depth=4).collect()
    assert [r["acc"] for r in got] == [r["acc"] for r in want] == pytest.approx([1.0, 1.0], abs=0.03)
