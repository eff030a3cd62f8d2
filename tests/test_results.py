"""Nulls in distances, results of repeated jobs, recorded columns and p-values."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabsieve.operators import neighbours
from tabsieve.operators.dbscan import dbscan
from tabsieve.operators.metric_names import direction
from tabsieve.operators.utility import correlation_p_value
from tabsieve.plans.suite import evaluate
from tabsieve.sources.stages import append_results, run_jobs
from tabsieve.spec import TableSpec


def test_null_features_are_named(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 2.0), (3, 0.1, 1.0)], "id long, a double, b double")
    for made in (lambda: dbscan(df, "id", ["b", "a"], [(0.5, 2)]), lambda: neighbours.knn(df, "id", ["b", "a"], 2),
                 lambda: neighbours.eps_neighbour_counts(df, "id", ["b", "a"], 0.5), lambda: neighbours.kth_distances(df, "id", ["b", "a"], 2)):
        with pytest.raises(PySparkException, match="feature a is null"):
            made().collect()
    assert dbscan(df, "id", ["b"], [(0.5, 2)]).count() == 3


def test_a_job_that_runs_again_leaves_one_copy(spark, tmp_path):
    path, jobs = f"{tmp_path}/results", spark.createDataFrame([("d", "base", "x"), ("d", "base", "y")], "dataset string, arm string, synth string")
    work = lambda job: spark.range(3).withColumn("v", F.lit(job["synth"]))
    run_jobs(jobs, work, path)
    run_jobs(jobs.where("synth = 'x'"), work, path)
    got = spark.read.parquet(path).groupBy("synth").count().collect()
    assert {r["synth"]: r["count"] for r in got} == {"x": 3, "y": 3}
    # A crash between the write and the return of the job: the rerun replaces what it left.
    append_results(spark.range(5).select("*", F.lit("d").alias("dataset"), F.lit("base").alias("arm"), F.lit("z").alias("synth")), path)
    run_jobs(jobs.limit(1).withColumn("synth", F.lit("z")), work, path)
    assert spark.read.parquet(path).where("synth = 'z'").count() == 3 and spark.read.parquet(path).count() == 9


def test_correlation_p_values(spark):
    # Two-sided 5 % points of r for n - 2 degrees of freedom, from a table.
    known = [(3, 0.9969173), (4, 0.95), (5, 0.87834), (6, 0.8114), (7, 0.75449), (8, 0.70673), (12, 0.57598), (22, 0.42271), (27, 0.38086)]
    df = spark.createDataFrame([(n, r) for n, r in known] + [(n, -r) for n, r in known], "n long, r double")
    for row in df.withColumn("p", correlation_p_value(F.col("r"), F.col("n"))).collect():
        assert row["p"] == pytest.approx(0.05, abs=2e-5), row
    edge = spark.createDataFrame([(2, 0.5), (10, 0.0), (11, 0.0), (10, 1.0), (11, -1.0)], "n long, r double")
    assert [r["p"] for r in edge.withColumn("p", correlation_p_value(F.col("r"), F.col("n"))).collect()] == [None, 1.0, 1.0, 0.0, pytest.approx(0, abs=1e-12)]


def test_recorded_columns(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(60)], "id long, a double, b double")
    spec = TableSpec(row_id="id", features=("a", "b"))
    out = {r["metric"]: r for r in evaluate(df, df, spec, {"sanity": ["data_mismatch"], "stats": ["survival_km_distance", "prdc"]}, rounds=2).collect()}
    r = out["sanity.data_mismatch.score"]
    assert (r["min"], r["max"], r["mean"], r["stddev"], r["median"], r["iqr"], r["rounds"], r["errors"]) == (0, 0, 0, 0, 0, 0, 2, 0) and r["durations"] > 0
    failed = out["stats.survival_km_distance"]
    assert failed["status"] == "failed" and failed["errors"] == 2 and failed["mean"] is None and failed["error"]
    assert out["stats.prdc.precision"]["mean"] == 1.0


def test_directions_of_metrics_and_attacks():
    assert direction("privacy.delta-presence.score", "recorded") == "maximize" and direction("privacy.delta-presence.score", "tables") == "minimize"
    assert {direction(f"DataLeakage{m}") for m in ("Linear", "MLP", "XGB")} | {direction("DomiasMIAKDE")} == {"minimize"}
    with pytest.raises(KeyError):
        direction("attack.unknown")
