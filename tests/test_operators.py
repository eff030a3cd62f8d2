import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import attack, compare, generate, marginal, privacy, utility
from tabsieve.operators import centre
from tabsieve.operators.centre import density_histogram, geometric_medians
from tabsieve.operators.diagnose import class_loss, pca_two, silhouette_squared
from tabsieve.plans.suite import evaluate
from tabsieve.plans.sweep import attack_sweep
from tabsieve.session import materialise
from tabsieve.sources.stages import StageStore, open_jobs
from tabsieve.spec import TableSpec


def test_medians_local_and_distributed_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.normal(size=(300, 2)), 1))]
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    for variant in ("plain", "vardi_zhang"):
        one = {r["cluster"]: (r["m_a"], r["m_b"]) for r in geometric_medians(df, ["a", "b"], variant=variant).collect()}
        two = {r["cluster"]: (r["m_a"], r["m_b"]) for r in geometric_medians(df, ["a", "b"], variant=variant, local_rows=10).collect()}
        assert set(one) == {0, 1, 2}
        for k in one:
            assert one[k] == pytest.approx(two[k], abs=1e-6)
            pts = np.array([r[1:] for r in rows if r[0] == k])
            cost = np.linalg.norm(pts - one[k], axis=1).sum()
            assert all(np.linalg.norm(pts - (np.array(one[k]) + s), axis=1).sum() >= cost - 1e-4 for s in ([0.01, 0], [0, -0.01]))


def test_large_groups_write_no_table_per_step_and_keep_null_keys(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, float(a), float(b)) for k in (0, 1, None) for a, b in rng.normal(size=(40 if k != 1 else 5, 2))]
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    one = {r["cluster"]: (r["m_a"], r["m_b"]) for r in geometric_medians(df, ["a", "b"], tol=0.0, max_iter=30).collect()}
    written = []
    monkeypatch.setattr(centre, "materialise", lambda d: written.append(1) or materialise(d))
    two = {r["cluster"]: (r["m_a"], r["m_b"]) for r in geometric_medians(df, ["a", "b"], tol=0.0, max_iter=30, local_rows=10).collect()}
    assert len(written) <= 4
    assert set(one) == set(two) == {0, 1, None}
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_variants_differ_on_a_centre_that_is_a_row(spark):
    df = spark.createDataFrame([(0, x) for x in (-4.0, 0.0, 1.0, 3.0)], "cluster int, a double")
    plain = geometric_medians(df, ["a"], variant="plain", max_iter=1).first()["m_a"]
    held = geometric_medians(df, ["a"], variant="vardi_zhang", max_iter=1).first()["m_a"]
    assert plain == pytest.approx(1 / (1 / 4 + 1 + 1 / 3)) and held == 0.0
    assert geometric_medians(df, ["a"], variant="vardi_zhang").first()["m_a"] == pytest.approx(0.0, abs=1e-3)


def test_class_loss_counts_lost_classes(spark):
    before = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "c string")
    after = before.where("c = 'a'").withColumn("config", F.lit(1))
    r = class_loss(before, after, "c", ["config"]).first()
    assert r["kept"] == 8 and r["overall_loss"] == pytest.approx(0.2) and r["worst_excess"] == pytest.approx(0.8) and not r["cap_ok"]


def test_histogram_integrates_to_one(spark):
    df = spark.createDataFrame([(0, float(i % 7)) for i in range(50)] + [(1, 3.0)] * 5, "cluster int, distance double")
    sums = density_histogram(df).groupBy("cluster").agg(F.sum(F.col("density") * (F.col("upper") - F.col("lower"))).alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in sums.collect())


def test_exact_tests_against_direct_sums(spark):
    df = spark.createDataFrame([(3, 9), (5, 5), (0, 7), (700, 650), (0, 0)], "wins int, losses int")
    got = [r["p"] for r in df.withColumn("p", compare.sign_test()).collect()]
    for p, (w, l) in zip(got, [(3, 9), (5, 5), (0, 7), (700, 650)]):
        assert p == pytest.approx(min(1.0, 2 * sum(math.comb(w + l, i) for i in range(min(w, l) + 1)) / 2 ** (w + l)), rel=1e-9)
    assert got[4] is None
    small = spark.createDataFrame([(0, float(v)) for v in (1, -2, 3, 4, 5, 6, 7)], "k int, dpct double")
    p = compare.with_wilcoxon_p(compare.wilcoxon(small, ["k"]), exact_up_to=25).first()["p_wilcoxon"]
    assert p == pytest.approx(2 * 3 / 2 ** 7)


def test_change_of_zero_and_formatting(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (2.0, 1.0)], "Orig double, Sanitised double").withColumn("direction", F.lit("minimize"))
    assert [r["dpct"] for r in compare.signed_change(df).collect()] == [-math.inf, None, 50.0]
    assert [r["sgn"] for r in compare.signed_change(df).collect()] == [-1.0, 0.0, 1.0]
    vals = spark.createDataFrame([(1234.5,), (12.34,), (0.1234,), (0.00123,), (math.inf,)], "v double")
    assert [r["t"] for r in vals.select(compare.format_value("v").alias("t")).collect()] == ["1235", "12.3", "0.123", "1.2e-03", "--"]


def test_metrics_of_a_table_with_itself(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    spec = TableSpec(row_id="p_partkey", features=("p_size", "p_retailprice"), quasi_identifiers=("p_size",), sensitive=("p_retailprice",))
    wanted = {"sanity": ["data_mismatch", "common_rows_proportion", "nearest_syn_neighbor_distance"],
              "stats": ["jensenshannon_dist", "inv_kl_divergence", "ks_test", "wasserstein_dist", "feature_corr", "chi_squared_test", "survival_km_distance"],
              "privacy": ["delta-presence", "k-anonymization"]}
    got = {r["metric"]: r for r in evaluate(part, part, spec, wanted).collect()}
    ideal = {"sanity.data_mismatch.score": 0, "sanity.common_rows_proportion.score": 1, "sanity.nearest_syn_neighbor_distance.mean": 0,
             "stats.jensenshannon_dist.marginal": 0, "stats.inv_kl_divergence.marginal": 1, "stats.ks_test.marginal": 1,
             "stats.wasserstein_dist.joint": 0, "stats.feature_corr.joint": 0, "stats.chi_squared_test.marginal": 1, "privacy.delta-presence.score": 1}
    for m, v in ideal.items():
        assert got[m]["mean"] == pytest.approx(v, abs=1e-6), m
    # a metric without its inputs is a failed row, an unknown one an error
    assert got["stats.survival_km_distance"]["status"] == "failed"
    with pytest.raises(ValueError):
        evaluate(part, part, spec, {"stats": ["nope"]})


def test_chi_squared_tail():
    assert marginal._upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, rel=1e-9)
    assert marginal._upper_gamma(5.0, 2.0) == pytest.approx(sum(2.0 ** i / math.factorial(i) for i in range(5)) * math.exp(-2.0))


def test_group_metrics_and_kmeans_groups(spark):
    real = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), (None, 9.0)], "g string, v double")
    syn = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 3.0), (None, 8.0)], "g string, v double")
    assert privacy.delta_presence(real, syn, ["g"]).first()[0] == pytest.approx(2.0)
    assert privacy.k_map(real, syn, ["g"]).first()[0] == 1.0
    assert privacy.l_diversity(syn, ["g"], ["v"]).first()[0] == 1.0
    _, _, cols = privacy.assign_groups(real, syn, ["v"], "kmeans", k=2)
    assert cols == ["_group"]


def test_generators(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet")
    n = 500
    m = generate.independent_marginals(part, ["p_size", "p_type"], n)
    assert m.count() == n and m.join(part.select("p_type").distinct(), "p_type", "left_anti").isEmpty()
    b = generate.bayesian_network(part, ["p_type", "p_brand", "p_size", "p_retailprice"], n)
    assert b.count() == n and b.where("p_type is null or p_brand is null or p_size is null or p_retailprice is null").isEmpty()
    tree = generate.chow_liu_tree([("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.5)], ["a", "b", "c"])
    assert tree == [("a", None), ("c", "a"), ("b", "c")]
    linked = spark.range(400).select((F.col("id") % 5).alias("x"), (F.col("id") % 5 * 3).alias("y"))
    assert generate.bayesian_network(linked, ["x", "y"], 300).where("y <> 3 * x").isEmpty()
    parts = {r["part"]: r["count"] for r in generate.split_train_holdout(part, "p_partkey").groupBy("part").count().collect()}
    assert parts == {"train": 140, "holdout": 60}


def test_attacks(spark):
    rows = spark.range(400).select((F.col("id") % 4).cast("double").alias("x"), F.when(F.col("id") % 4 < 2, "lo").otherwise("hi").alias("s"),
                                   F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("t"))
    real = rows.unionByName(rows.limit(1).withColumn("s", F.lit("new")))
    out = {r["model"]: r for r in attack.attribute_inference(real, rows, "s", trees=5, depth=4, max_iter=50).collect()}
    assert set(out) == {"logreg", "rf"} and out["rf"]["acc"] == 1.0 and out["rf"]["n_classes"] == 3
    assert out["rf"]["advantage"] == pytest.approx(1.0 - out["rf"]["baseline"], abs=1e-4)
    flat = attack.attribute_inference(real, rows.withColumn("s", F.lit("lo")), "s").first()
    assert flat["degenerate"] and flat["model"] == "n/a" and flat["advantage"] == 0.0 and flat["bal_acc"] == pytest.approx(1 / 3, abs=1e-4)
    jobs = spark.createDataFrame([("d", "base", "a"), ("d", "base", "broken")], "dataset string, arm string, synth string")

    def load(job):
        if job["synth"] == "broken":
            raise OSError("no such table")
        return real, rows.withColumn("s", F.lit("lo")), ["s"]

    got = {r["synth"]: r for r in attack_sweep(jobs, load).collect()}
    assert got["a"]["status"] == "ok" and got["broken"]["status"] == "failed" and "OSError" in got["broken"]["error"]


def test_membership_tables_and_singular_covariance(spark):
    base = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.lit(1.0).alias("c"),
                                   (F.col("id") % 17 * -2).cast("double").alias("d"))
    members, hold, dropped = attack.membership_tables(base, base.where("a < 10"), "id")
    assert dropped == ["c", "d"] and hold.count() == 60 and members.where("a >= 10").isEmpty()
    syn = base.select((F.col("id") + 1000).alias("id"), "a", "b")
    scores = attack.domias(members, hold, syn, hold, "id", "id", ["a", "b"])
    got = attack.membership_scores(scores).first()
    assert 0.0 <= got["auroc"] <= 1.0 and got["n_neg"] == 60
    with pytest.raises(ValueError):
        attack.domias(members.withColumn("e", F.col("a")), hold.withColumn("e", F.col("a")), syn.withColumn("e", F.col("a")),
                      hold.withColumn("e", F.col("a")), "id", "id", ["a", "e"])


def test_auroc_and_detection(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert utility.auroc_by_ranks(df, "s", "y").first()["auroc"] == pytest.approx(4.5 / 6)
    a = spark.range(300).select("id", F.randn(1).alias("x"), F.randn(2).alias("y"))
    far = spark.range(300).select("id", (F.randn(3) + 4).alias("x"), F.randn(4).alias("y"))
    got = {r["metric"]: r["value"] for r in utility.detection(a, far, ["x", "y"], "id", "id", ("linear", "gmm"), folds=2).collect()}
    assert got["detection.detection_linear.mean"] > 0.95 and got["detection.detection_gmm.mean"] > 0.9


def test_pca_and_squared_silhouette(spark):
    df = spark.range(60).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 2 + F.col("id") % 3).cast("double").alias("b"),
                                (F.col("id") % 7).cast("double").alias("c"), (F.col("id") > 30).cast("int").alias("cluster"))
    out = pca_two(df, ["a", "b", "c"])
    stats = out.agg(F.avg("PC1"), F.avg("PC2"), F.corr("PC1", "PC2"), F.variance("PC1"), F.variance("PC2")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[2] == pytest.approx(0, abs=1e-6) and stats[3] > stats[4]
    assert 0 < silhouette_squared(df, ["a", "b", "c"]) < 1


def test_stage_store_and_open_jobs(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "demo")
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    store.write(df, 8, csv=True, compression="gzip")
    assert store.read(8).collect() == df.collect()
    assert [p for p in (tmp_path / "demo_8_decoded_data.csv").iterdir() if p.name.endswith(".csv.gz")]
    store.write_config(spark.createDataFrame([(0.5, 4)], "eps double, mp int"))
    assert store.read_config().first()["mp"] == 4
    jobs = spark.createDataFrame([("a", "b", "c"), ("a", "b", "d")], "dataset string, arm string, synth string")
    assert open_jobs(jobs, jobs.limit(1)).count() == 1


def test_registered_suites_ask_for_every_family(spark, small, monkeypatch):
    """Both queries ask for all families; a few quick model metrics of them are run."""
    from tabsieve.plans.suite import FAMILIES
    from tabsieve.queries import QUERIES, metrics
    quick, asked = {"performance": ["linear_model"], "detection": ["detection_linear"]}, []

    def noted(run, place):
        def call(*values):
            asked.append(values[place])
            return run(*values[:place], quick)
        return call
    monkeypatch.setattr(metrics, "evaluate", noted(metrics.evaluate, 3))
    monkeypatch.setattr(metrics, "two_arms", noted(metrics.two_arms, 4))
    names = {"performance.linear_model.syn_id", "performance.linear_model.syn_ood", "detection.detection_linear.mean"}
    rows = QUERIES["m31_metric_suite"](spark, small).collect()
    assert {r["metric"] for r in rows if r["status"] == "ok" and 0 <= r["mean"] <= 1} == names
    assert {r["Metric"] for r in QUERIES["m31_two_arm_comparison"](spark, small).collect()} == names
    for wanted in asked:
        assert (wanted if isinstance(wanted, dict) else {f: FAMILIES[f] for f in wanted}) == FAMILIES
    assert len(asked) == 2


def test_metrics_of_the_suite_run_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(2, timeout=30)

    def value(*args):
        meet.wait()  # breaks where metrics run one after the other
        return spark.range(1).select(F.lit(0.5).alias("value"))

    monkeypatch.setattr(marginal, "data_mismatch", value)
    monkeypatch.setattr(marginal, "common_rows", value)
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "id long, a double")
    got = evaluate(df, df, TableSpec(row_id="id", features=("a",)), {"sanity": ["data_mismatch", "common_rows_proportion"]}).collect()
    assert [(r["metric"], r["mean"], r["status"]) for r in got] == [
        ("sanity.data_mismatch.score", 0.5, "ok"), ("sanity.common_rows_proportion.score", 0.5, "ok")]
