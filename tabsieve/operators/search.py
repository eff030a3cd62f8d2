"""Configuration grids, their scoring and the choice among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.operators.centre import centre_distances, geometric_medians
from tabsieve.operators.dbscan import attach_labels
from tabsieve.operators.diagnose import class_loss, cluster_summary
from tabsieve.operators.filters import admissible, closest_cluster_count, stratified_trim
from tabsieve.operators.forest import label_grid
from tabsieve.operators.neighbours import median_pair_distance, metric_space, prepare
from tabsieve.operators.scale import SingularCovariance, standardise
from tabsieve.operators.silhouette import silhouette_points
from tabsieve.session import materialise

# Default grid of the search.
DEFAULT_EPS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
DEFAULT_MIN_SAMPLES = (3, 4, 5, 6, 7, 8, 9)
#: Configurations labelled together; bounds the rows one pass multiplies out.
CONFIG_BATCH = 128


def parameter_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of the given value lists, one column per axis."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def _labelled(z: DataFrame, id_col: str, zcols: Sequence[str], configs: Sequence[tuple[float, int]], metric: str):
    """Yield (offset, points, labels, tiles) per batch of configurations."""
    for at in range(0, len(configs), CONFIG_BATCH):
        points, labels, tiles = label_grid(z, id_col, zcols, configs[at:at + CONFIG_BATCH], metric)
        yield at, points, labels, tiles


def grid_search(df: DataFrame, id_col: str, features: Sequence[str], eps_values: Sequence[float] = DEFAULT_EPS,
                min_samples_values: Sequence[int] = DEFAULT_MIN_SAMPLES, metrics: Sequence[str] = ("euclidean", "manhattan", "mahalanobis"),
                algorithms: Sequence[str] = ("auto",), leaf_sizes: Sequence[int] = (30,),
                p_values: Sequence[float | None] = (None,)) -> DataFrame:
    """One row per configuration: clusters, noise share and silhouette on standardised columns.

    ``algorithms``, ``leaf_sizes`` and ``p_values`` do not change labels: each
    distinct labelling is computed once and fanned out to them by a join. Where the covariance is singular,
    the Mahalanobis configurations stay as rows with null measures; rankings and choices pass over them.
    """
    spark = df.sparkSession
    z = materialise(standardise(df, features).select(id_col, *[f"z_{c}" for c in features]))
    zcols = [f"z_{c}" for c in features]
    parts = []
    for metric in metrics:
        configs = [(float(e), int(m)) for e in eps_values for m in min_samples_values]
        try:
            space, cols, plain = metric_space(z, zcols, metric, strict=True)
        except SingularCovariance:
            parts.append(spark.createDataFrame([(None, None, None, e, m, metric) for e, m in configs], "num_clusters long, "
                         "percentage_outliers double, silhouette_score double, eps double, min_samples int, metric string"))
            continue
        for at, points, labels, tiles in _labelled(space, id_col, cols, configs, plain):
            rows = labels.join(points.select("pid", "copies"), "pid")
            sums = rows.groupBy("config_id").agg(
                F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("num_clusters"),
                (F.sum(F.when(F.col("cluster") < 0, F.col("copies")).otherwise(0)) / F.sum("copies")).alias("percentage_outliers"))
            # The silhouette is always Euclidean on the standardised columns.
            if plain == "euclidean" and metric == "euclidean":
                sil = silhouette_points(tiles, labels)
            else:
                p2, t2, l2 = _relabel(z, id_col, zcols, space, cols, points, labels, tiles)
                sil = silhouette_points(t2, l2)
            named = spark.createDataFrame([(i, e, m) for i, (e, m) in enumerate(configs[at:at + CONFIG_BATCH])],
                                          "config_id int, eps double, min_samples int")
            parts.append(materialise(sums.join(sil, "config_id").join(named, "config_id").drop("config_id")
                                     .withColumn("metric", F.lit(metric))
                                     .withColumnRenamed("silhouette", "silhouette_score")))
    base = parts[0]
    for p in parts[1:]:
        base = base.unionByName(p)
    inert = parameter_grid(spark, metric=list(metrics), algorithm=list(algorithms), leaf_size=list(leaf_sizes),
                           p=list(p_values))
    return base.join(inert, "metric")


def _relabel(z, id_col, zcols, space, cols, points, labels, tiles):
    """Labels found in another metric, re-keyed to points of the standardised columns."""
    rows = attach_labels(space.select(id_col, *dict.fromkeys([*zcols, *cols])), id_col, cols, points, labels, tiles)
    p2, t2 = prepare(z, id_col, zcols)
    keyed = rows.select(F.col(id_col).alias("pid"), "config_id", "cluster")
    # equal vectors share every label, so the row carrying a point's id speaks for all its copies
    return p2, t2, materialise(keyed.join(p2.select("pid"), "pid", "left_semi"))


def rank_configurations(grid: DataFrame, target_noise: float, num_clusters: int | None = None, top_n: int = 5,
                        epsilon: float = 1e-6) -> DataFrame:
    """Lowest ``(|clusters - wanted| + epsilon) * (1 - silhouette) * |noise - target|`` first."""
    score = (1 - F.col("silhouette_score")) * F.abs(F.col("percentage_outliers") - target_noise)
    if num_clusters is not None:
        score = (F.abs(F.col("num_clusters") - num_clusters) + epsilon) * score
    return (grid.where(F.col("silhouette_score") >= 0).withColumn("_score", score)
            .orderBy("_score", "eps", "min_samples", *[c for c in ("metric", "algorithm", "leaf_size") if c in grid.columns])
            .limit(top_n).drop("_score"))


def rank_by_noise(grid: DataFrame, target_noise: float, num_clusters: int | None = None, top_n: int = 5) -> DataFrame:
    """Older ranking: nearest cluster count, then distance to the wanted noise share."""
    grid = grid.where(F.col("percentage_outliers").isNotNull())
    rows = grid if num_clusters is None else closest_cluster_count(grid, num_clusters)
    return (rows.withColumn("_d", F.abs(F.col("percentage_outliers") - target_noise))
            .orderBy("_d", "eps", "min_samples", *[c for c in ("metric",) if c in grid.columns]).limit(top_n).drop("_d"))


def order_grid(grid: DataFrame, min_silhouette: float | None = None) -> DataFrame:
    rows = grid if min_silhouette is None else grid.where(F.col("silhouette_score") >= min_silhouette)
    return rows.orderBy(F.desc("silhouette_score"), F.desc("num_clusters"), F.asc("percentage_outliers"))


def capped_search(df: DataFrame, id_col: str, features: Sequence[str], target: str,
                  configs: Sequence[tuple[float, int]], tau: float = 0.10, min_kept_share: float | None = 0.4,
                  min_kept: int | None = None, variant: str = "plain", max_iter: int = 400) -> tuple[DataFrame, list[DataFrame]]:
    """Search table of the class-capped sanitiser, and the kept rows per batch.

    Clusters come from standardised columns, distances from the raw encoded ones.
    Per configuration: k, noise, silhouette, kept rows, overall loss, worst class
    excess, cap flag and score ``(1 - max(sil, 0)) * |noise - tau|``.
    """
    spark = df.sparkSession
    raw = df.select(F.col(id_col), F.col(target).alias("_class"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(features)])
    z = materialise(standardise(raw, features))
    zcols = [f"z_{c}" for c in features]
    tables, kept_parts = [], []
    for at, points, labels, tiles in _labelled(z, id_col, zcols, configs, "euclidean"):
        rows = materialise(attach_labels(z, id_col, zcols, points, labels, tiles).drop(*zcols))
        summary = materialise(cluster_summary(rows, ["config_id"]).where(F.col("num_clusters") >= 2))
        members = rows.where(F.col("cluster") >= 0).join(F.broadcast(summary.select("config_id")), "config_id", "left_semi")
        centres = materialise(geometric_medians(members, features, ["config_id", "cluster"], variant, max_iter=max_iter))
        far = materialise(centre_distances(members, centres, features, ["config_id", "cluster"])
                          .select(id_col, "_class", "config_id", "cluster", "distance"))
        kept = materialise(stratified_trim(far, tau, ["config_id", "cluster", "_class"]))
        loss = class_loss(raw, kept, "_class", ["config_id"], tau)
        named = spark.createDataFrame([(i, at + i, float(e), int(m)) for i, (e, m) in enumerate(configs[at:at + CONFIG_BATCH])],
                                      "config_id int, config int, eps double, mp int")
        sil = silhouette_points(tiles, labels)
        table = (summary.join(sil, "config_id").join(loss, "config_id").join(named, "config_id")
                 .select("config", "eps", "mp", F.col("num_clusters").alias("k"), F.col("noise_share").alias("noise"),
                         F.col("silhouette").alias("sil"), "kept", "overall_loss", "worst_excess", "cap_ok", "n_rows"))
        tables.append(materialise(table))
        kept_parts.append(kept.join(F.broadcast(named.select("config_id", "config")), "config_id").drop("config_id"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    if min_kept_share is not None:
        out = out.where(F.col("kept") >= min_kept_share * F.col("n_rows"))
    if min_kept is not None:
        out = out.where(F.col("kept") >= min_kept)
    out = out.withColumn("score", (1 - F.greatest(F.col("sil"), F.lit(0.0))) * F.abs(F.col("noise") - tau))
    return out.drop("n_rows"), kept_parts


def choose(search: DataFrame) -> DataFrame:
    """The best admissible configuration (one row), or none."""
    return admissible(search).orderBy("score", "eps", "mp").limit(1)


def relative_eps(df: DataFrame, id_col: str, zcols: Sequence[str], fractions: Sequence[float], n: int = 1200,
                 seed: int = 0) -> list[float]:
    """Eps values as fractions of the median pairwise distance."""
    unit = median_pair_distance(df, id_col, zcols, n, seed)
    return [f * unit for f in fractions]
