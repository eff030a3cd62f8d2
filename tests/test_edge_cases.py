"""Null keys, late failures, exact tests, generators with nulls, membership slices and pruned kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.functions.ranking import exact_quantiles
from tabsieve.operators.compare import sign_test
from tabsieve.operators.filters import stratified_trim
from tabsieve.operators.generate import bayesian_network, independent_marginals, mutual_information, uniform_sampler
from tabsieve.operators.neighbours import eps_pairs, kernel_sums, prepare
from tabsieve.plans.membership import holdout_slices, membership_inference
from tabsieve.sources.stages import run_jobs


def test_null_groups_keep_their_quantiles_and_rows(spark):
    rows = [(None, float(i)) for i in range(10)] + [("a", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "class string, distance double").withColumn("cluster", F.lit(None).cast("int"))
    got = {r["class"]: r["median"] for r in exact_quantiles(df, ["class"], "distance", [0.5], ["median"]).collect()}
    assert got == {None: 4.5, "a": 2.0}
    kept = stratified_trim(df, 0.1, ["cluster", "class"])
    assert kept.groupBy("class").count().collect() and kept.where("class is null").count() == 9 and kept.where("class = 'a'").count() == 4


def test_sign_test_of_any_size(spark):
    pairs = [(0, 0), (1, 0), (3, 5), (22, 11), (200, 150), (500_300, 500_000)]
    got = spark.createDataFrame(pairs, "wins long, losses long").withColumn("p", sign_test()).collect()

    def exact(w, n):
        tail = sum(math.comb(n, k) for k in range(min(w, n - w) + 1))
        return min(1.0, 2 * tail / 2 ** n)
    for r in got[1:-1]:
        assert r["p"] == pytest.approx(exact(r["wins"], r["wins"] + r["losses"]), rel=1e-10)
    assert got[0]["p"] is None
    z = (300 - 1) / math.sqrt(1_000_300)  # continuity-corrected normal
    assert got[-1]["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_jobs_that_fail_in_the_data_become_rows(spark):
    jobs = spark.createDataFrame([("d", "a", "good"), ("d", "a", "late")], "dataset string, arm string, synth string")
    data = spark.createDataFrame([("1",), ("x" * 300,)], "v string")

    def work(job):
        return data.where(F.lit(job["synth"] == "late") | (F.col("v") == "1")).select(F.col("v").cast("int").alias("n"))
    out = [p.collect() for p in run_jobs(jobs, work)]
    assert [r["status"] for rows in out for r in rows] == ["ok", "failed"]
    assert "x" * 300 in out[1][0]["error"]


def test_generators_keep_nulls_and_row_counts(spark):
    rows = [(i % 3 if i % 4 else None, "p" if i % 2 else None, float(i) if i % 5 else None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d string")
    for made in (independent_marginals(df, ["a", "b", "c", "d"], 300), bayesian_network(df, ["a", "b", "c", "d"], 300),
                 uniform_sampler(df, ["c"], ["a", "d"], 300)):
        assert made.count() == 300 and made.where("d is not null").count() == 0
    out = independent_marginals(df, ["a", "b"], 2000)
    assert 0.2 < out.where("a is null").count() / 2000 < 0.3 and 0.45 < out.where("b is null").count() / 2000 < 0.55
    mi = {(r["col_a"], r["col_b"]): r["mi"] for r in mutual_information(df.withColumn("e", F.col("b")), ["b", "e", "d"]).collect()}
    assert mi["b", "e"] == pytest.approx(math.log(2)) and mi["b", "d"] == pytest.approx(0.0)


def test_membership_slices_are_disjoint(spark):
    hold = spark.range(101).select("id", F.rand(1).alias("x"))
    a, b = holdout_slices(hold, "id", 50)
    assert a.count() == b.count() == 50 and a.join(b, "id").count() == 0
    base = spark.range(400).select("id", (F.randn(1)).alias("x"), F.randn(2).alias("y"), F.lit(1).alias("same"))
    syn = spark.range(200).select(F.col("id").alias("sid"), F.randn(3).alias("x"), F.randn(4).alias("y"))
    row = membership_inference(base, base.where("id % 5 < 4"), lambda _: syn, "id", "sid").first()
    assert row["status"] == "ok" and row["n_nonmembers"] == row["reference_size"] == 60 and row["n_cols_dropped"] == 1 and 0.3 < row["auroc"] < 0.7
    small = membership_inference(base.where("id < 60"), base, lambda _: syn, "id", "sid").first()
    assert small["status"] == "too small" and small["auroc"] is None


def test_kernels_and_pairs_of_far_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (1500, 2)), rng.normal(1e6, 1, (1500, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double")
    far = spark.createDataFrame([(i, -1e9, float(i)) for i in range(5)], "id long, x double, y double")
    _, refs = prepare(df, "id", ["x", "y"])
    _, lone = prepare(far, "id", ["x", "y"])
    got = {r["pid"]: r["total"] for r in kernel_sums(refs, refs, 0.5).collect()}
    want = np.exp(-0.5 * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)).sum(1)
    assert len(got) == 3000 and np.allclose([got[i] for i in range(3000)], want)
    assert [r["total"] for r in kernel_sums(lone, refs, 0.5).collect()] == [0.0] * 5
    pairs = eps_pairs(df, "id", ["x", "y"], 0.01).collect()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert {(r["id_a"], r["id_b"]) for r in pairs} == {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= 0.01, 1)))}
