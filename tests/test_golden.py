"""Recorded facts: configuration searches, paired results, pivots, winners and attack rows."""

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import compare, filters, search
from tabsieve.operators.metric_names import METRIC_NAMES, metric_parts, with_metric_info
from tabsieve.operators.search import choose
from tabsieve.plans.sanitiser import capped_sanitiser
from tabsieve.session import materialise
from tabsieve.sources.tables import read_credit, read_csv, read_number_lines, with_row_id
from tabsieve.spec import TableSpec


def test_credit_table_end_to_end(spark, fixtures):
    credit = materialise(with_row_id(read_credit(spark, f"{fixtures}/credit.data")))
    assert credit.count() == 1000 and len(credit.columns) == 22
    spec = TableSpec(row_id="row_id", target="class")
    out = capped_sanitiser(credit, spec, fractions=(0.5, 0.6, 0.7), min_samples=(3, 10), impute=False)
    table = {(round(r["eps"] / 6.287728, 3), r["mp"]): r for r in out.search.collect()}
    for key, (k, noise, sil, kept) in {(0.5, 3): (10, 0.384, -0.110263, 546), (0.6, 3): (4, 0.152, 0.112763, 761),
                                       (0.7, 3): (3, 0.044, 0.156566, 859), (0.7, 10): (2, 0.085, 0.176703, 822)}.items():
        r = table[key]
        assert (r["k"], r["kept"]) == (k, kept)
        assert r["noise"] == pytest.approx(noise) and r["sil"] == pytest.approx(sil, abs=1e-6)
    best = out.chosen.first()
    assert best["eps"] == pytest.approx(4.401409685264902) and best["mp"] == 10
    assert best["worst_excess"] == pytest.approx(0.03533333333)
    assert {r["class"]: r["n"] - r["removed"] for r in out.audit.collect()} == {1: 586, 2: 236}
    assert out.table.count() == 822 and out.table.columns == credit.columns


def test_default_search_equals_the_recorded_one(spark, fixtures):
    credit = materialise(with_row_id(read_credit(spark, f"{fixtures}/credit.data")))
    got = capped_sanitiser(credit, TableSpec(row_id="row_id", target="class"), impute=False).search.orderBy("eps", "mp").collect()
    want = read_csv(spark, f"{fixtures}/credit_search.csv").orderBy("eps", "mp").collect()
    assert len(got) == len(want) == 14
    for g, w in zip(got, want):
        assert (g["mp"], g["k"], g["kept"], g["cap_ok"]) == (w["mp"], w["k"], w["kept"], w["cap_ok"])
        for c in ("eps", "noise", "sil", "overall_loss", "worst_excess", "score"):
            assert g[c] == pytest.approx(w[c], abs=1e-6), c


def test_number_lines(spark, fixtures):
    t = read_number_lines(spark, f"{fixtures}/credit_numbers.data", [f"c{i}" for i in range(25)])
    assert t.count() == 50 and t.first()["c1"] == 6.0 and t.where("c24 is null").count() == 0


def test_recorded_searches(spark, fixtures):
    g = read_csv(spark, f"{fixtures}/credit_search.csv")
    assert g.count() == 14 and filters.admissible(g).count() == 11
    best = choose(g).first()
    assert (best["frac"], best["mp"]) == (0.7, 10) and best["score"] == pytest.approx(0.012349, abs=1e-6)
    c = read_csv(spark, f"{fixtures}/cohort_search.csv")
    assert c.count() == 53 and filters.admissible(c, min_kept=200).count() == 11
    best = choose(c).first()
    assert (best["eps"], best["mp"], best["kept"], best["pos_kept"]) == (9, 10, 726, 42)
    assert search.relative_eps is not None


def test_pairing_reproduces_paired_tables(spark, fixtures):
    long = read_csv(spark, f"{fixtures}/runs_long.csv").withColumn("metric", F.regexp_replace("metric", r"^(\w+)\.", "$1."))
    paired = compare.pair_arms(long).withColumn("short", metric_parts(F.col("metric"))["short_metric"])
    want = read_csv(spark, f"{fixtures}/paired.csv").where("version = 'second'").select(
        "dataset", F.col("metric").alias("short"), F.col("synthesizer").alias("synth"), F.col("Orig").alias("o"), F.col("Sanitised").alias("s"),
        F.col("metric_category").alias("cat"))
    both = want.join(paired, ["dataset", "short", "synth"])
    assert want.count() == 306 == both.count() == paired.count()
    off = both.agg(F.max(F.abs(F.col("o") - F.col("Orig"))), F.max(F.abs(F.col("s") - F.col("Sanitised"))),
                   F.sum((F.col("cat") != F.col("metric_category")).cast("int"))).first()
    assert off[0] < 1e-12 and off[1] < 1e-12 and off[2] == 0


def changes(spark, fixtures, version):
    p = read_csv(spark, f"{fixtures}/paired.csv")
    rows = p.where("version = 'second' or dataset = 'health'") if version == "tables" else p.where("version = 'first'")
    # metric names here may carry the family or not
    info = with_metric_info(rows, version)
    return materialise(compare.signed_change(info).withColumn("family", F.col("metric_category")))


def test_significance_table(spark, fixtures):
    t = {(r["dataset"], r["family"]): r for r in compare.significance(changes(spark, fixtures, "tables")).collect()}
    for ds, w, l, tie, med, rb in (("cervical", 14, 19, 3, -16.73, 0.166), ("german", 22, 11, 3, 84.29, 0.522), ("health", 2, 34, 0, -75.0, -0.928)):
        r = t[ds, "privacy"]
        assert (r["wins"], r["losses"], r["ties"]) == (w, l, tie)
        assert r["median_change"] == pytest.approx(med, abs=0.005) and r["rank_biserial"] == pytest.approx(rb, abs=6e-4)
    assert t["cervical", "privacy"]["p_wilcoxon"] == pytest.approx(0.406, abs=5e-4)
    assert t["german", "privacy"]["p_wilcoxon"] == pytest.approx(0.0088, abs=5e-5)
    assert t["health", "privacy"]["p_wilcoxon"] < 1e-4
    for ds, sanity, stats in (("cervical", 0.722, 0.455), ("german", 0.556, 0.465), ("health", 0.444, 0.343)):
        for fam, share in (("sanity", sanity), ("stats", stats)):
            r = t[ds, fam]
            assert r["wins"] / r["n"] == pytest.approx(share, abs=6e-4)
    for r in t.values():
        assert r["p_sign_holm"] >= r["p_sign"] - 1e-12 and r["ci_low"] <= r["wins"] / (r["wins"] + r["losses"]) <= r["ci_high"]


def test_change_pivots(spark, fixtures):
    got = changes(spark, fixtures, "tables_first")
    want = read_csv(spark, f"{fixtures}/pivot_change.csv").withColumn("metric", metric_parts(F.col("metric"))["short_metric"])
    got = got.withColumn("metric", F.when(F.col("metric").rlike("^(privacy|sanity|stats)[.]"), metric_parts(F.col("metric"))["short_metric"]).otherwise(F.col("metric")))
    both = want.join(got, ["dataset", "metric", "synthesizer"]).where("value is not null and dpct is not null and abs(dpct) < double('inf')")
    assert both.count() > 400
    per = both.withColumn("bad", (F.abs(F.col("value") - F.col("dpct")) > 0.0051 + 1e-9).cast("int")).groupBy("dataset").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    counts = {r["dataset"]: (r["bad"], r["n"]) for r in per.collect()}
    assert counts["german"][0] == 0, counts
    wide = compare.pivot_wide(got, ["dataset", "metric"], "synthesizer", ["adsgan", "arf"], "dpct")
    assert wide.columns == ["dataset", "metric", "adsgan", "arf"]


def test_winner_rule(spark, fixtures):
    w = read_csv(spark, f"{fixtures}/winners.csv").where("better in ('results 1', 'results 2')")
    w = w.withColumn("metric", F.col("Metric")).where(F.col("Metric").isin(*METRIC_NAMES))
    info = materialise(with_metric_info(w, "recorded"))
    side = lambda c: info.select("synthesizer", "metric", F.col(c).cast("double").alias("mean"), "direction")
    truth = lambda d: d.unionByName(d.where("metric like '%.syn'").withColumn("metric", F.regexp_replace("metric", "syn$", "gt")).withColumn("mean", F.lit(1.0)))
    got = compare.compare_results(truth(side("orig")), truth(side("sanitised")), ["synthesizer"])
    both = got.withColumnRenamed("Metric", "metric").join(
        info.select("synthesizer", "metric", "better", F.col("magnitude").alias("size")), ["synthesizer", "metric"])
    bad = both.where((F.col("Better Results") != F.col("better")) | (F.col("Magnitude") != F.col("size"))).collect()
    assert both.count() >= 275 and not bad, bad[:3]


def test_attack_rows(spark, fixtures):
    a = read_csv(spark, f"{fixtures}/attack_rows.csv")
    assert a.count() == 176
    assert {r["model"]: r["count"] for r in a.groupBy("model").count().collect()} == {"logreg": 80, "rf": 80, "n/a": 16}
    assert a.where("model <> 'n/a' and abs(round(acc - baseline, 4) - advantage) > 1e-9").count() == 0
    assert a.where("degenerate").select("dataset", "arm").distinct().collect()[0][:] == ("cervical", "sanitised")
    times = {r["dataset"]: r for r in compare.run_times(a.dropDuplicates(["dataset", "arm", "synth"]), ["dataset"]).collect()}
    assert times["cervical"]["total_secs"] == pytest.approx(1157.5) and times["german"]["max_secs"] == pytest.approx(277.1)
