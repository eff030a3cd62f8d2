"""Cluster summaries, class-loss audits, equivalence classes and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.ranking import exact_quantiles
from tabsieve.operators.filters import distinct_counts
from tabsieve.operators.scale import moments
from tabsieve.session import materialise


def cluster_summary(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Clusters without noise, noise rows and noise share."""
    noise = F.col("cluster") == -1
    sizes = labelled.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(
        F.sum(F.when(~noise, 1).otherwise(0)).cast("long").alias("num_clusters"),
        F.sum(F.when(noise, F.col("n")).otherwise(0)).cast("long").alias("n_noise"),
        F.sum("n").cast("long").alias("n_rows"),
    ).withColumn("noise_share", F.col("n_noise") / F.col("n_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) over non-null values."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    n = total.first()["total"] or 0
    return counted.withColumn("share", F.col("n") / F.lit(float(n or 1)))


def majority_share(df: DataFrame, column: str) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("n_classes"), (F.max("n") / F.sum("n")).alias("baseline"))


def quasi_identifiers(df: DataFrame, columns: Sequence[str], max_distinct: int = 20) -> list[str]:
    counts = distinct_counts(df, columns)
    return [c for c in columns if counts[c] <= max_distinct]


def equivalence_classes(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """Group sizes over the quasi-identifiers; nulls form groups of their own."""
    return df.groupBy(*qi).agg(F.count(F.lit(1)).alias("size"))


def equivalence_summary(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """One row: number of groups, median group size, share of rows that are alone."""
    sizes = materialise(equivalence_classes(df, qi))
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    median = exact_quantiles(sizes, [], "size", [0.5], ["median_size"]).first()
    alone = F.sum(F.when(F.col("size") == 1, F.col("groups")).otherwise(0))
    return by_size.agg(F.sum("groups").cast("long").alias("n_groups"),
                       F.lit(median["median_size"] if median else None).alias("median_size"),
                       (alone / F.sum(F.col("size") * F.col("groups"))).alias("unique_share"))


def removal_audit(before: DataFrame, after: DataFrame, target: str, tau: float = 0.10) -> DataFrame:
    """Per class: rows, removed, rate, whether rate - overall <= tau, and the overall rate."""
    n = before.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    kept = after.groupBy(target).agg(F.count(F.lit(1)).alias("kept"))
    per_class = n.join(kept, target, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    overall = per_class.agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).first()
    rate_all = 1.0 - (overall["kept"] or 0) / (overall["n"] or 1)
    rate = (F.col("n") - F.col("kept")) / F.col("n")
    return per_class.select(target, F.col("n").cast("long").alias("n"),
                            (F.col("n") - F.col("kept")).cast("long").alias("removed"), rate.alias("rate"),
                            (rate - F.lit(rate_all) <= F.lit(tau + 1e-9)).alias("cap_ok"),
                            F.lit(rate_all).alias("overall_rate"))


def class_loss(before: DataFrame, after: DataFrame, target: str, keys: Sequence[str] = (), tau: float = 0.10) -> DataFrame:
    """Overall loss, worst excess of a class loss over it, and the cap flag, per key of ``after``."""
    n = materialise(before.groupBy(target).agg(F.count(F.lit(1)).alias("n")))
    whole = n.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")).first()
    kept = after.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("kept"))
    per = kept.join(n, target).withColumn("loss", 1 - F.col("kept") / F.col("n"))
    # A class without a kept row has no line here and has lost everything.
    worst = F.when(F.count(F.lit(1)) < whole["classes"], 1.0).otherwise(F.max("loss"))
    return (per.groupBy(*keys).agg(F.sum("kept").cast("long").alias("kept"),
                                   (1 - F.sum("kept") / F.lit(float(whole["n"]))).alias("overall_loss"), worst.alias("_w"))
            .withColumn("worst_excess", F.col("_w") - F.col("overall_loss")).drop("_w")
            .withColumn("cap_ok", F.col("worst_excess") <= F.lit(tau + 1e-9)))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: count, nulls, mean, sample deviation, min, quartiles, max."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.column", "p.v")
    base = long.groupBy("column").agg(
        F.count("v").alias("n"), F.sum(F.when(F.col("v").isNull(), 1).otherwise(0)).cast("long").alias("n_null"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    quart = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]).drop("n_values")
    return base.join(quart, "column", "left")


def schema_info(df: DataFrame) -> DataFrame:
    """Per column: position, type and null count."""
    nulls = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), int(nulls[f"n{i}"] or 0)) for i, f in enumerate(df.schema)],
        "position int, column string, type string, n_null long")


def grid_extremes(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best silhouette (at least -1) and least noise (at most 1) over a search table."""
    return grid.where(F.col("k") >= 2).groupBy(*keys).agg(
        F.greatest(F.max("sil"), F.lit(-1.0)).alias("best_sil"), F.least(F.min("noise"), F.lit(1.0)).alias("min_noise"))


def pca_two(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Add PC1 and PC2. The largest loading of each component is made positive."""
    src = fit_on if fit_on is not None else df
    mean, _ = moments(src, columns)

    def centred(t):
        return t.select("*", *[(F.col(c).cast("double") - F.lit(float(m))).alias(f"_p{i}")
                               for i, (c, m) in enumerate(zip(columns, mean))])

    asm = VectorAssembler(inputCols=[f"_p{i}" for i in range(len(columns))], outputCol="_v")
    model = PCA(k=2, inputCol="_v", outputCol="_pc").fit(asm.transform(centred(src)))
    loads = model.pc.toArray()
    sign = [1.0 if loads[abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(asm.transform(centred(df))).withColumn("_a", vector_to_array("_pc"))
    return out.select(*df.columns, (F.col("_a")[0] * sign[0]).alias("PC1"), (F.col("_a")[1] * sign[1]).alias("PC2"))


def silhouette_squared(df: DataFrame, features: Sequence[str], label: str = "cluster") -> float | None:
    """MLlib's silhouette, which uses squared distances (not the Euclidean silhouette); None where fewer than two labels exist.

    MLlib raises there, as no row has another cluster to be compared with.
    """
    if df.select(label).distinct().limit(2).count() < 2:
        return None
    asm = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.withColumn(
        "prediction", F.col(label).cast("double")))
    return ClusteringEvaluator(predictionCol="prediction", featuresCol="features").evaluate(asm)


def kmeans_groups(df: DataFrame, features: Sequence[str], k: int, seed: int = 42, name: str = "group") -> tuple[object, DataFrame]:
    asm = VectorAssembler(inputCols=list(features), outputCol="_kv")
    model = KMeans(k=k, seed=seed, featuresCol="_kv", predictionCol=name).fit(asm.transform(df))
    return model, model.transform(asm.transform(df)).drop("_kv")
