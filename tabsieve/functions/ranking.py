"""Exact order statistics without pulling a whole group into one task.

A plain ``row_number().over(partitionBy(k).orderBy(v))`` sorts each group in one
task, which fails when one group holds a large share of the rows. Here values are
first counted (partial aggregation removes hot values), the distinct values are
range-partitioned, and running totals are computed per range and shifted by the
totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsieve.session import materialise, null_safe_join


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], weights: Sequence[str],
                   following: str | None = None) -> DataFrame:
    """Add ``before_<w>`` and ``total_<w>`` per weight column, and the next ``order[0]`` as ``following``.

    ``df`` must hold at most one row per (keys, order). The range number is stored
    by the checkpoint, so every later read of it agrees.
    """
    keys, order = list(keys), list(order)
    ranged = materialise(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
        .withColumn("_range", F.spark_partition_id()))
    per_range = ranged.groupBy(*keys, "_range").agg(F.min(order[0]).alias("_first"),
                                                    *[F.sum(w).alias(f"_s_{w}") for w in weights])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, "_range", F.lead("_first").over(group.orderBy("_range")).alias("_next"),
        *[F.coalesce(F.sum(f"_s_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(group).alias(f"total_{w}") for w in weights])
    local = (Window.partitionBy(*keys, "_range").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    out = null_safe_join(ranged, offsets, [*keys, "_range"])
    for w in weights:
        out = out.withColumn(f"before_{w}", F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(local), F.lit(0)))
    if following:
        ahead = F.lead(order[0]).over(Window.partitionBy(*keys, "_range").orderBy(*order))
        out = out.withColumn(following, F.coalesce(ahead, "_next"))
    return out.drop("_range", "_next", *[f"_o_{w}" for w in weights])


def number_rows(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "rn",
                total: str | None = None) -> DataFrame:
    """Dense 1-based position of each row under a unique ``order``."""
    out = running_totals(df.withColumn("_one", F.lit(1)), keys, order, ["_one"])
    out = out.withColumn(name, (F.col("before__one") + 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("total__one").cast("long"))
    return out.drop("_one", "before__one", "total__one")


def value_positions(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct value: ``n`` copies, ``before`` smaller rows, ``total`` rows.

    The mean rank of the value is ``before + (n + 1) / 2``.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("n"))
    return (running_totals(counted, keys, [value], ["n"])
            .withColumnRenamed("before_n", "before").withColumnRenamed("total_n", "total"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group (same rule as ``percentile``); ``weight`` counts copies."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    pos = value_positions(df, keys, value, weight)

    def at(rank):
        inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_f{i}")]
    out = pos.groupBy(*keys).agg(F.max("total").cast("long").alias("n_values"), *aggs)
    return out.select(*keys, "n_values", *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(nm)
        for i, nm in enumerate(names)])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rank per distinct value; tied rows share the mean rank."""
    return (value_positions(df, keys, value)
            .withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)))
