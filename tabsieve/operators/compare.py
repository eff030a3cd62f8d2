"""Win/loss, relative change and rank tests over paired metric tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsieve.functions.ranking import exact_quantiles, number_rows, value_positions
from tabsieve.operators.filters import finite_non_zero, finite_or_null
from tabsieve.operators.metric_names import REPORTED
from tabsieve.session import broadcast_if, materialise, null_safe_join

_INF = float("inf")


def signed_change(df: DataFrame, old: str = "Orig", new: str = "Sanitised", direction: str = "direction") -> DataFrame:
    """Add ``sgn`` and ``dpct``: change in the preferred direction, its sign and its per cent of |old|.

    A zero old value gives an infinite change, or null when nothing changed.
    """
    s = F.when(F.col(direction) == "maximize", 1.0).otherwise(-1.0)
    diff = s * (F.col(new) - F.col(old))
    pct = F.when(F.col(old) != 0, diff / F.abs(F.col(old)) * 100.0)
    return df.withColumn("sgn", F.signum(diff)).withColumn(
        "dpct", F.coalesce(pct, F.when(diff > 0, F.lit(_INF)).when(diff < 0, F.lit(-_INF))))


def format_value(column: str) -> Column:
    """Digits by magnitude; ``--`` for missing or infinite values."""
    v, a = F.col(column), F.abs(F.col(column))
    return (F.when(v.isNull() | F.isnan(v) | (a == _INF), "--")
            .when(a >= 1000, F.format_string("%.0f", v)).when(a >= 10, F.format_string("%.1f", v))
            .when(a >= 0.01, F.format_string("%.3f", v)).otherwise(F.format_string("%.1e", v)))


def format_change(column: str) -> Column:
    v, a = F.col(column), F.abs(F.col(column))
    return (F.when(v.isNull() | F.isnan(v) | (a == _INF), "--")
            .when(a >= 100, F.format_string("%+.0f", v)).otherwise(F.format_string("%+.1f", v)))


def compare_results(first: DataFrame, second: DataFrame, keys: Sequence[str] = (), marginal: float = 0.05) -> DataFrame:
    """Which of two (metric, mean, direction) tables is better per metric.

    Ground-truth rows are skipped, a ``.syn`` row is only compared when its
    ``.gt`` partner agrees, a tie or a missing value goes to the second table.
    """
    keys = list(keys)
    a = first.select(*keys, "metric", F.col("mean").alias("orig"), "direction")
    b = second.select(*keys, "metric", F.col("mean").alias("sanitised"))
    both = a.join(b, [*keys, "metric"], "left")
    truth = (both.where(F.col("metric").endswith(".gt"))
             .select(*keys, F.regexp_replace("metric", r"\.gt$", ".syn").alias("metric"),
                     F.coalesce(F.col("orig") != F.col("sanitised"), F.lit(True)).alias("differ")))
    rows = both.where(~F.col("metric").endswith(".gt")).join(truth, [*keys, "metric"], "left")
    error = F.coalesce("differ", F.lit(False))
    gain = F.when(F.col("direction") == "minimize", F.col("sanitised") - F.col("orig")) \
        .when(F.col("direction") == "maximize", F.col("orig") - F.col("sanitised"))
    better = (F.when(error, "Error").when(gain > 0, "results 1")
              .when(F.col("direction").isin("minimize", "maximize"), "results 2").otherwise("N/A"))
    size = F.when(error, "Ground truth values differ").when(F.abs(F.col("orig") - F.col("sanitised")) < marginal, "marginally") \
        .otherwise("by far")
    return rows.select(*keys, F.col("metric").alias("Metric"), better.alias("Better Results"), size.alias("Magnitude"),
                       F.when(~error, F.col("orig")).alias("orig"), F.when(~error, F.col("sanitised")).alias("sanitised"))


def proportion_improved(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.when(F.col("sgn") > 0, 1.0).otherwise(0.0)).alias("improved"))


def pivot_wide(df: DataFrame, rows: Sequence[str], across: str, values: Sequence, value: str) -> DataFrame:
    """One column per listed value of ``across`` (listing them avoids an extra job)."""
    return df.groupBy(*rows).pivot(across, list(values)).agg(F.first(value, ignorenulls=True))


def win_loss(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wins, losses, ties and the median finite relative change per group."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(a)
          for a, c in (("wins", F.col("sgn") > 0), ("losses", F.col("sgn") < 0))])
    counts = counts.withColumn("ties", F.col("n") - F.col("wins") - F.col("losses"))
    med = exact_quantiles(df.withColumn("_d", finite_or_null("dpct")), keys, "_d", [0.5], ["median_change"]).drop("n_values")
    return null_safe_join(counts, med, list(keys), "left")


def _log_gamma(x: Column) -> Column:
    """Stirling's series, shifted by eight so that it holds from 1 on."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def sign_test(wins: str = "wins", losses: str = "losses") -> Column:
    """Exact two-sided sign test p-value, from the binomial tail at one half.

    The tail is built outwards from its largest term, which comes from log-gamma.
    Terms fall at least like ``exp(-2 j^2 / n)``, so those beyond ten square roots
    of ``n`` are below the last digit of the sum; no array grows with the pairs.
    """
    n, m = (F.col(wins) + F.col(losses)).cast("double"), F.least(F.col(wins), F.col(losses)).cast("double")
    log_top = _log_gamma(n + 1) - _log_gamma(m + 1) - _log_gamma(n - m + 1) - n * math.log(2.0)
    last = F.least(m, F.ceil(10 * F.sqrt(n)) + 50).cast("int")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t"))
    tail = F.aggregate(F.sequence(F.lit(0), last), start,
                       lambda acc, j: F.struct((acc["s"] + acc["t"]).alias("s"),
                                               (acc["t"] * (m - j) / (n - m + j + 1)).alias("t")))["s"]
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * F.exp(log_top) * tail))


def wilson(wins: str = "wins", losses: str = "losses", z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval for the share of wins among untied pairs."""
    n = (F.col(wins) + F.col(losses)).cast("double")
    p = F.col(wins) / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def signed_ranks(df: DataFrame, keys: Sequence[str], value: str = "dpct") -> DataFrame:
    """(keys, |value|, avg_rank, n_pos, n_neg): mean ranks of absolute finite non-zero changes."""
    rows = finite_non_zero(df, value).withColumn("_abs", F.abs(F.col(value)))
    ranks = value_positions(rows, keys, "_abs").withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))
    sides = rows.groupBy(*keys, "_abs").agg(F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).alias("n_pos"),
                                            F.sum(F.when(F.col(value) < 0, 1).otherwise(0)).alias("n_neg"))
    return null_safe_join(ranks, sides, [*keys, "_abs"])


def wilcoxon(df: DataFrame, keys: Sequence[str], value: str = "dpct") -> DataFrame:
    """Signed-rank sums, tie-corrected normal z, and rank-biserial correlation per group."""
    r = signed_ranks(df, keys, value)
    n, nd = F.col("n_used"), F.col("n_used").cast("double")
    sums = r.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n_used"),
        F.sum(F.col("avg_rank") * F.col("n_pos")).alias("w_plus"), F.sum(F.col("avg_rank") * F.col("n_neg")).alias("w_minus"),
        F.sum(F.col("n").cast("double") * (F.col("n") * F.col("n") - 1)).alias("_ties"),
        F.max("n").alias("_most"))
    var = nd * (nd + 1) * (2 * nd + 1) / 24 - F.col("_ties") / 48
    z = (F.least("w_plus", "w_minus") - nd * (nd + 1) / 4) / F.sqrt(var)
    return (sums.withColumn("z", F.when((n > 5) & (var > 0), z))
            .withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))
            .withColumn("tie_free", F.col("_most") == 1).drop("_ties", "_most"))


def _exact_tail(n: int, w: float) -> float:
    """P(W <= w) for n untied ranks, from the number of subsets of 1..n per sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return sum(ways[:int(math.floor(w)) + 1]) / 2 ** n


#: Largest untied group whose Wilcoxon p-value is exact by default.
EXACT_UP_TO = 50


def with_wilcoxon_p(tests: DataFrame, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Add ``p_wilcoxon``: exact for small untied groups, else the normal tail. Runs on one row per group."""
    @F.pandas_udf("double")
    def p_value(n: pd.Series, w: pd.Series, z: pd.Series, free: pd.Series) -> pd.Series:
        out = []
        for ni, wi, zi, fi in zip(n, w, z, free):
            if ni <= 5 or pd.isna(zi):
                out.append(None)
            elif fi and ni <= exact_up_to:
                out.append(min(1.0, 2 * _exact_tail(int(ni), wi)))
            else:
                out.append(min(1.0, math.erfc(abs(zi) / math.sqrt(2))))
        return pd.Series(out, dtype="float64")

    return tests.withColumn("p_wilcoxon", p_value("n_used", F.least("w_plus", "w_minus"), "z", "tie_free"))


def holm(df: DataFrame, keys: Sequence[str], p: str, order: Sequence[str], name: str) -> DataFrame:
    """Holm-Bonferroni within each group: running maximum of (m - rank + 1) p, at most 1.

    ``order`` makes equal p-values unique. Positions and the running maximum use
    range-wise totals, so a large family does not end up in one task.
    """
    keys = list(keys)
    ranked = materialise(number_rows(df.where(F.col(p).isNotNull()), [p, *order], keys, "_rn", total="_m")
                         .withColumn("_raw", (F.col("_m") - F.col("_rn") + 1) * F.col(p))
                         .withColumn("_block", F.floor(F.col("_rn") / 100_000)))
    per = ranked.groupBy(*keys, "_block").agg(F.max("_raw").alias("_top"))
    group = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per.select(*keys, "_block", F.max("_top").over(group).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    out = (ranked.join(earlier, [*keys, "_block"])
           .withColumn(name, F.least(F.lit(1.0), F.greatest(F.coalesce("_before", F.lit(0.0)), F.max("_raw").over(within)))))
    return out.drop("_rn", "_m", "_raw", "_block", "_before")


def significance(df: DataFrame, dataset: str = "dataset", family: str = "family") -> DataFrame:
    """The full test table per (dataset, family) from rows with sgn and dpct."""
    keys = [dataset, family]
    signs = win_loss(df, keys).withColumn("p_sign", sign_test()).withColumn("ci_low", wilson()[0]).withColumn("ci_high", wilson()[1])
    base = materialise(null_safe_join(signs, with_wilcoxon_p(wilcoxon(df, keys)), keys, "left"))
    a = holm(base.select(*keys, "p_sign"), [dataset], "p_sign", [family], "p_sign_holm").drop("p_sign")
    b = holm(base.select(*keys, "p_wilcoxon"), [dataset], "p_wilcoxon", [family], "p_wilcoxon_holm").drop("p_wilcoxon")
    return null_safe_join(null_safe_join(base, a, keys, "left"), b, keys, "left")


def melt_sources(df: DataFrame, values: Sequence[str] = ("orig", "sanitised")) -> DataFrame:
    """Unpivot the value columns into (Source, Value)."""
    ids = [c for c in df.columns if c not in set(values)]
    return df.unpivot(ids, list(values), "Source", "Value")


def pair_arms(long: DataFrame, metrics: Sequence[str] | None = REPORTED, arms: Sequence[str] = ("base", "sanitised"),
              names: Sequence[str] = ("Orig", "Sanitised")) -> DataFrame:
    """Long results (dataset, arm, synth, metric, mean) to one row with both arms side by side."""
    rows = long if metrics is None else long.where(F.col("metric").isin(list(metrics)))
    wide = pivot_wide(rows, ["dataset", "synth", "metric"], "arm", arms, "mean")
    for a, n in zip(arms, names):
        wide = wide.withColumnRenamed(a, n)
    return wide.withColumn("metric_category", F.split("metric", r"\.")[0])


def value_spread(melted: DataFrame, keys: Sequence[str] = ("Metric", "Source"), value: str = "Value") -> DataFrame:
    """Minimum, quartiles and maximum per metric and source."""
    return exact_quantiles(melted, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0], ["low", "q1", "median", "q3", "high"])


def run_times(results: DataFrame, keys: Sequence[str] = ("dataset", "synth"), value: str = "secs") -> DataFrame:
    base = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.sum(value).alias("total_secs"), F.max(value).alias("max_secs"))
    return null_safe_join(base, exact_quantiles(results, keys, value, [0.5], ["median_secs"]).drop("n_values"), list(keys), "left")


def point_lookup(wanted: DataFrame, table: DataFrame, keys: Sequence[str], table_rows: int) -> DataFrame:
    """Values of a long table for the wanted (metric, model) pairs, in the wanted shape."""
    return wanted.join(broadcast_if(table, table_rows * 64), list(keys), "left")


def tagged_union(kept: DataFrame, outliers: DataFrame) -> DataFrame:
    return (kept.withColumn("is_outlier", F.lit(False))
            .unionByName(outliers.withColumn("is_outlier", F.lit(True)), allowMissingColumns=True))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
