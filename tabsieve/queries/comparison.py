"""Paired-result comparison on results derived from every order line."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.operators import compare, filters
from tabsieve.operators.metric_names import METRIC_NAMES, direction, metric_parts, with_metric_info
from tabsieve.queries.registry import METRIC_OF_FLAG, PAIRED_SQL, paired, query, rounded, table
from tabsieve.session import materialise

CH = f"WITH {PAIRED_SQL}"


def changes(spark, folder):
    return compare.signed_change(paired(spark, folder)).withColumn("family", metric_parts(F.col("metric"))["family"])


@query("p16_signed_change", f"{CH} SELECT dataset, synthesizer, metric, sgn, round(dpct, 4) AS dpct FROM ch")
def signed(spark, folder):
    return rounded(changes(spark, folder).select("dataset", "synthesizer", "metric", "sgn", "dpct"), "dpct")


@query("p17_format_numbers", """
SELECT p_partkey, CASE WHEN v IS NULL THEN '--' WHEN abs(v) >= 1000 THEN printf('%.0f', v) WHEN abs(v) >= 10 THEN printf('%.1f', v)
  WHEN abs(v) >= 0.01 THEN printf('%.3f', v) ELSE printf('%.1e', v) END AS value_text,
  CASE WHEN c IS NULL THEN '--' WHEN abs(c) >= 100 THEN printf('%+.0f', c) ELSE printf('%+.1f', c) END AS change_text
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_retailprice * 7.0123 WHEN 1 THEN p_retailprice / 77.0 WHEN 2 THEN p_retailprice / 7777.0
   WHEN 3 THEN CASE WHEN p_size > 25 THEN NULL ELSE p_retailprice / 777777.0 END END AS v, (25 - p_size) * 7.013 AS c FROM part)""")
def formats(spark, folder):
    p, size = F.col("p_retailprice"), F.col("p_size") % 4
    v = F.when(size == 0, p * 7.0123).when(size == 1, p / 77.0).when(size == 2, p / 7777.0).when(F.col("p_size") <= 25, p / 777777.0)
    rows = table(spark, folder, "part").withColumn("v", v).withColumn("c", (25 - F.col("p_size")) * F.lit(7.013))
    return rows.select("p_partkey", compare.format_value("v").alias("value_text"), compare.format_change("c").alias("change_text"))


LONG = """
lg AS MATERIALIZED (SELECT l_linestatus AS arm, l_returnflag AS dataset, l_suppkey AS synth, m.metric, m.direction,
   CAST(sum(CAST(round(CASE m.col WHEN 1 THEN l_discount WHEN 2 THEN l_tax ELSE l_quantity END * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean
   FROM lineitem, (VALUES ('privacy.k-anonymization.gt', 'maximize', 1), ('privacy.k-anonymization.syn', 'maximize', 2),
   ('sanity.data_mismatch.score', 'minimize', 3)) m(metric, direction, col) GROUP BY ALL)"""


def long_results(spark, folder):
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / F.count(F.lit(1))
    wide = table(spark, folder, "lineitem").groupBy(F.col("l_linestatus").alias("arm"), F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("synth")) \
        .agg(cents("l_discount").alias("privacy.k-anonymization.gt"), cents("l_tax").alias("privacy.k-anonymization.syn"),
             cents("l_quantity").alias("sanity.data_mismatch.score"))
    names = wide.columns[3:]
    return wide.unpivot(["arm", "dataset", "synth"], [f"`{n}`" for n in names], "metric", "mean")


@query("p18_metric_parts", f"WITH {LONG} SELECT DISTINCT metric, split_part(metric, '.', 1) AS family, regexp_replace(metric, '^[^.]*\\.', '') AS short_metric, "
       "regexp_replace(metric, '\\.(syn|gt)$', '') AS base_metric FROM lg")
def parts(spark, folder):
    p = metric_parts(F.col("metric"))
    return long_results(spark, folder).select("metric", *[v.alias(k) for k, v in p.items()]).distinct()


_DIM = ", ".join(f"('{m}', '{METRIC_NAMES[m]}', '{direction(m, 'tables')}')" for m in METRIC_OF_FLAG.values())


@query("p19_metric_dimension", f"{CH} SELECT ch.dataset, ch.metric, d.name, d.dir AS direction, count(*) AS n "
       f"FROM ch JOIN (VALUES {_DIM}) d(metric, name, dir) ON ch.metric = d.metric GROUP BY ALL")
def dimension(spark, folder):
    rows = with_metric_info(paired(spark, folder).drop("direction"), "tables")
    return rows.groupBy("dataset", "metric", "name", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("f10_drop_ground_truth", f"WITH {LONG} SELECT arm, dataset, synth, metric, round(mean, 4) AS mean FROM lg WHERE NOT metric LIKE '%.gt'")
def no_truth(spark, folder):
    return rounded(filters.drop_ground_truth(long_results(spark, folder)), "mean")


@query("f11_finite_non_zero", f"{CH} SELECT dataset, synthesizer, metric, round(dpct, 4) AS dpct FROM ch WHERE dpct IS NOT NULL AND dpct <> 0 AND NOT isinf(dpct)")
def finite(spark, folder):
    return rounded(filters.finite_non_zero(changes(spark, folder), "dpct").select("dataset", "synthesizer", "metric", "dpct"), "dpct")


@query("j9_paired_comparison", f"""WITH {LONG},
w AS (SELECT dataset, synth, metric, direction, max(mean) FILTER (WHERE arm = 'O') AS v1, max(mean) FILTER (WHERE arm = 'F') AS v2 FROM lg GROUP BY ALL
      HAVING count(*) FILTER (WHERE arm = 'O') > 0),
t AS (SELECT dataset, synth, v1 AS g1, v2 AS g2 FROM w WHERE metric LIKE '%.gt'),
x AS (SELECT w.*, metric LIKE '%.syn' AND coalesce(round(g1, 1) <> round(g2, 1), true) AS bad FROM w JOIN t USING (dataset, synth) WHERE NOT metric LIKE '%.gt')
SELECT dataset, synth, metric AS "Metric",
  CASE WHEN bad THEN 'Error' WHEN (CASE direction WHEN 'minimize' THEN v2 - v1 ELSE v1 - v2 END) > 0 THEN 'results 1' ELSE 'results 2' END AS "Better Results",
  CASE WHEN bad THEN 'Ground truth values differ' WHEN abs(v1 - v2) < 0.05 THEN 'marginally' ELSE 'by far' END AS "Magnitude",
  CASE WHEN NOT bad THEN round(v1, 4) END AS orig, CASE WHEN NOT bad THEN round(v2, 4) END AS sanitised FROM x""")
def paired_comparison(spark, folder):
    rows = long_results(spark, folder).withColumn("direction", F.when(F.col("metric").startswith("sanity"), "minimize").otherwise("maximize"))
    rows = materialise(rows.withColumn("mean", F.when(F.col("metric").endswith(".gt"), F.round("mean", 1)).otherwise(F.col("mean"))))
    out = compare.compare_results(rows.where(F.col("arm") == "O"), rows.where(F.col("arm") == "F"), ["dataset", "synth"])
    return rounded(out, "orig", "sanitised")


@query("j12_metric_model_lookup", f"""{CH}, want AS (SELECT DISTINCT 's' || CAST(s_suppkey AS VARCHAR) AS synthesizer, m.metric FROM supplier,
  (VALUES ('privacy.k-map.score'), ('stats.ks_test.marginal')) m(metric))
SELECT want.synthesizer, want.metric, ch.dataset, round(ch.Orig, 4) AS Orig FROM want LEFT JOIN ch ON want.synthesizer = ch.synthesizer AND want.metric = ch.metric""")
def lookup(spark, folder):
    rows = materialise(changes(spark, folder).select("synthesizer", "metric", "dataset", "Orig"))
    want = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("synthesizer"),
                                                   F.explode(F.array(F.lit("privacy.k-map.score"), F.lit("stats.ks_test.marginal"))).alias("metric"))
    return rounded(compare.point_lookup(want, rows, ["synthesizer", "metric"], rows.count()), "Orig")


@query("a18_proportion_by_dataset", f"{CH} SELECT dataset, family, round(avg(CASE WHEN sgn > 0 THEN 1.0 ELSE 0.0 END), 6) AS improved FROM ch GROUP BY 1, 2")
def by_dataset(spark, folder):
    return rounded(compare.proportion_improved(changes(spark, folder), ["dataset", "family"]), "improved", digits=6)


@query("a18_proportion_by_model", f"""{CH} SELECT synthesizer, round(avg(CASE WHEN sgn > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE family = 'privacy'), 6) AS privacy,
  round(avg(CASE WHEN sgn > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE family = 'sanity'), 6) AS sanity,
  round(avg(CASE WHEN sgn > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE family = 'stats'), 6) AS stats FROM ch GROUP BY 1""")
def by_model(spark, folder):
    out = compare.pivot_wide(compare.proportion_improved(changes(spark, folder), ["synthesizer", "family"]), ["synthesizer"], "family",
                             ["privacy", "sanity", "stats"], "improved")
    return rounded(out, "privacy", "sanity", "stats", digits=6)


WINS = f"""{CH}, w AS (SELECT dataset, family, count(*) AS n, count(*) FILTER (WHERE sgn > 0) AS wins, count(*) FILTER (WHERE sgn < 0) AS losses,
  quantile_cont(CASE WHEN NOT isinf(dpct) THEN dpct END, 0.5) AS median_change FROM ch GROUP BY 1, 2)"""


@query("a19_win_loss", f"{WINS} SELECT dataset, family, n, wins, losses, n - wins - losses AS ties, round(median_change, 4) AS median_change FROM w")
def wins(spark, folder):
    return rounded(compare.win_loss(changes(spark, folder), ["dataset", "family"]), "median_change")


SIGN_CTE = """sg AS (SELECT dataset, family, wins, losses, least(1.0, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1)
  - (wins + losses) * ln(2.0)))) AS p FROM (SELECT w.*, unnest(range(0, least(wins, losses) + 1)) AS i FROM w) GROUP BY ALL)"""


@query("a20_sign_test", f"{WINS}, {SIGN_CTE} SELECT dataset, family, round(p, 6) AS p_sign FROM sg")
def signs(spark, folder):
    out = compare.win_loss(changes(spark, folder), ["dataset", "family"]).withColumn("p_sign", compare.sign_test())
    return rounded(out.select("dataset", "family", "p_sign"), "p_sign", digits=6)


RANKS = f"""{CH}, f AS (SELECT dataset, family, dpct, abs(dpct) AS a FROM ch WHERE dpct IS NOT NULL AND dpct <> 0 AND NOT isinf(dpct)),
r AS (SELECT *, rank() OVER (PARTITION BY dataset, family ORDER BY a) + (count(*) OVER (PARTITION BY dataset, family, a) - 1) / 2.0::DOUBLE AS rk,
      count(*) OVER (PARTITION BY dataset, family, a) AS t FROM f),
s AS (SELECT dataset, family, count(*) AS n, coalesce(sum(rk) FILTER (WHERE dpct > 0), 0) AS wp, coalesce(sum(rk) FILTER (WHERE dpct < 0), 0) AS wm,
      sum(t * t - 1) AS ties, max(t) AS most FROM r GROUP BY 1, 2),
z AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)"""


@query("a21_wilcoxon_statistic", f"{RANKS} SELECT dataset, family, n AS n_used, round(wp, 2) AS w_plus, round(wm, 2) AS w_minus, round(z, 4) AS z FROM z")
def signed_rank(spark, folder):
    out = compare.wilcoxon(changes(spark, folder), ["dataset", "family"])
    return rounded(rounded(out.select("dataset", "family", "n_used", "w_plus", "w_minus", "z"), "w_plus", "w_minus", digits=2), "z")


# normal tail by Simpson's rule on [0, |z|]
TAIL = """p AS (SELECT dataset, family, 1 - 2 * sum(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * exp(-0.5 * (abs(z) * k / 2000.0::DOUBLE) * (abs(z) * k / 2000.0::DOUBLE))) * abs(any_value(z)) / 6000.0::DOUBLE / sqrt(2 * pi()) AS p
  FROM z, range(0, 2001) g(k) GROUP BY dataset, family)"""


@query("a21_wilcoxon_p_value", f"{RANKS}, {TAIL} SELECT dataset, family, round(p, 5) AS p_wilcoxon FROM p")
def signed_rank_p(spark, folder):
    out = compare.with_wilcoxon_p(compare.wilcoxon(changes(spark, folder), ["dataset", "family"]))
    return rounded(out.select("dataset", "family", "p_wilcoxon"), "p_wilcoxon", digits=5)


@query("a22_rank_biserial", f"{RANKS} SELECT dataset, family, round((wp - wm) / (wp + wm), 6) AS rank_biserial FROM s")
def biserial(spark, folder):
    return rounded(compare.wilcoxon(changes(spark, folder), ["dataset", "family"]).select("dataset", "family", "rank_biserial"), "rank_biserial", digits=6)


@query("a23_wilson_interval", f"""{WINS}, q AS (SELECT *, CAST(wins + losses AS DOUBLE) AS m, wins / (wins + losses) AS ph, 1.96::DOUBLE AS k FROM w)
SELECT dataset, family, round((ph + k * k / (2 * m)) / (1 + k * k / m) - k * sqrt(ph * (1 - ph) / m + k * k / (4 * m * m)) / (1 + k * k / m), 6) AS ci_low,
  round((ph + k * k / (2 * m)) / (1 + k * k / m) + k * sqrt(ph * (1 - ph) / m + k * k / (4 * m * m)) / (1 + k * k / m), 6) AS ci_high FROM q""")
def interval(spark, folder):
    low, high = compare.wilson()
    out = compare.win_loss(changes(spark, folder), ["dataset", "family"]).select("dataset", "family", low.alias("ci_low"), high.alias("ci_high"))
    return rounded(out, "ci_low", "ci_high", digits=6)


@query("w1_signed_ranks", f"{RANKS} SELECT dataset, family, round(a, 6) AS magnitude, round(any_value(rk), 2) AS avg_rank, count(*) AS n FROM r GROUP BY dataset, family, a")
def rank_rows(spark, folder):
    out = compare.signed_ranks(changes(spark, folder), ["dataset", "family"])
    out = out.select("dataset", "family", F.col("_abs").alias("magnitude"), "avg_rank", F.col("n").cast("long").alias("n"))
    return rounded(rounded(out, "magnitude", digits=6), "avg_rank", digits=2)


# one p-value per supplier, so a family holds as many tests as there are suppliers
PER_MODEL = f"""{CH}, w AS (SELECT dataset, synthesizer AS family, count(*) FILTER (WHERE sgn > 0) AS wins, count(*) FILTER (WHERE sgn < 0) AS losses FROM ch GROUP BY 1, 2),
{SIGN_CTE}"""


@query("w2_holm_correction", f"""{PER_MODEL}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p, family) AS rn, count(*) OVER (PARTITION BY dataset) AS m
  FROM (SELECT dataset, family, round(p, 9) AS p FROM sg))
SELECT dataset, family AS synthesizer, round(p, 6) AS p_sign, round(least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY dataset ORDER BY rn)), 6) AS p_holm FROM o""")
def holm(spark, folder):
    rows = changes(spark, folder).groupBy("dataset", "synthesizer").agg(
        F.sum(F.when(F.col("sgn") > 0, 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("sgn") < 0, 1).otherwise(0)).alias("losses"))
    rows = rows.withColumn("p_sign", F.round(compare.sign_test(), 9)).where(F.col("wins") + F.col("losses") > 0)
    out = compare.holm(rows.select("dataset", "synthesizer", "p_sign"), ["dataset"], "p_sign", ["synthesizer"], "p_holm")
    return rounded(out.select("dataset", "synthesizer", "p_sign", "p_holm"), "p_sign", "p_holm", digits=6)


@query("significance_table", f"""{RANKS}, {TAIL}, w AS (SELECT dataset, family, count(*) AS n, count(*) FILTER (WHERE sgn > 0) AS wins, count(*) FILTER (WHERE sgn < 0) AS losses,
  quantile_cont(CASE WHEN NOT isinf(dpct) THEN dpct END, 0.5) AS median_change FROM ch GROUP BY 1, 2), {SIGN_CTE},
b AS (SELECT w.*, sg.p AS p_sign, p.p AS p_w, (wp - wm) / (wp + wm) AS rb FROM w JOIN sg USING (dataset, family) JOIN p USING (dataset, family) JOIN s USING (dataset, family)),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p_sign, family) AS r1, row_number() OVER (PARTITION BY dataset ORDER BY p_w, family) AS r2,
      count(*) OVER (PARTITION BY dataset) AS m FROM b)
SELECT dataset, family, wins, losses, round(median_change, 4) AS median_change, round(rb, 4) AS rank_biserial,
  round(least(1.0, max((m - r1 + 1) * p_sign) OVER (PARTITION BY dataset ORDER BY r1)), 5) AS p_sign_holm,
  round(least(1.0, max((m - r2 + 1) * p_w) OVER (PARTITION BY dataset ORDER BY r2)), 5) AS p_wilcoxon_holm FROM o""")
def significance(spark, folder):
    out = compare.significance(materialise(changes(spark, folder)))
    out = out.select("dataset", "family", "wins", "losses", "median_change", "rank_biserial", "p_sign_holm", "p_wilcoxon_holm")
    return rounded(rounded(out, "median_change", "rank_biserial"), "p_sign_holm", "p_wilcoxon_holm", digits=5)


@query("a25_run_times", """
SELECT l_linestatus AS dataset, l_suppkey AS synth, count(*) AS runs, round(sum(l_quantity), 2) AS total_secs, round(max(l_quantity), 2) AS max_secs,
       round(median(l_quantity), 2) AS median_secs FROM lineitem GROUP BY 1, 2""")
def times(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("dataset"), F.col("l_suppkey").alias("synth"), F.col("l_quantity").alias("secs"))
    return rounded(compare.run_times(rows), "total_secs", "max_secs", "median_secs", digits=2)


@query("r1_unpivot_sources", f"""{CH} SELECT dataset, synthesizer, metric, direction, 'Orig' AS "Source", round(Orig, 4) AS "Value" FROM ch
UNION ALL SELECT dataset, synthesizer, metric, direction, 'Sanitised', round(Sanitised, 4) FROM ch""")
def melt(spark, folder):
    return rounded(compare.melt_sources(paired(spark, folder), ("Orig", "Sanitised")), "Value")


@query("r2_pivot_change", f"""{CH} SELECT dataset, synthesizer, round(max(dpct) FILTER (WHERE family = 'privacy'), 2) AS privacy,
  round(max(dpct) FILTER (WHERE family = 'sanity'), 2) AS sanity, round(max(dpct) FILTER (WHERE family = 'stats'), 2) AS stats FROM ch GROUP BY 1, 2""")
def pivot(spark, folder):
    out = compare.pivot_wide(changes(spark, folder), ["dataset", "synthesizer"], "family", ["privacy", "sanity", "stats"], "dpct")
    return rounded(out, "privacy", "sanity", "stats", digits=2)


@query("r4_pair_arms", f"""WITH {LONG} SELECT dataset, synth, metric, round(max(mean) FILTER (WHERE arm = 'O'), 4) AS "Orig",
  round(max(mean) FILTER (WHERE arm = 'F'), 4) AS "Sanitised", split_part(metric, '.', 1) AS metric_category FROM lg GROUP BY 1, 2, 3""")
def arms(spark, folder):
    out = compare.pair_arms(long_results(spark, folder), metrics=None, arms=("O", "F"))
    return rounded(out, "Orig", "Sanitised")


@query("r5_value_spread", f"""{CH}, m AS (SELECT metric, 'Orig' AS src, Orig AS v FROM ch UNION ALL SELECT metric, 'Sanitised', Sanitised FROM ch)
SELECT metric, src AS "Source", count(*) AS n_values, round(min(v), 4) AS low, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median,
  round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS high FROM m GROUP BY 1, 2""")
def spread(spark, folder):
    melted = compare.melt_sources(paired(spark, folder), ("Orig", "Sanitised"))
    return rounded(compare.value_spread(melted, ["metric", "Source"]), "low", "q1", "median", "q3", "high")
