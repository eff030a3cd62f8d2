"""Metric dimension: display names and preferred directions, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Recorded metric name -> evaluator name.
METRIC_NAMES = {
    "sanity.data_mismatch.score": "DataMismatchScore",
    "sanity.common_rows_proportion.score": "CommonRowsProportion",
    "sanity.nearest_syn_neighbor_distance.mean": "NearestSyntheticNeighborDistance",
    "sanity.close_values_probability.score": "CloseValuesProbability",
    "sanity.distant_values_probability.score": "DistantValuesProbability",
    "stats.jensenshannon_dist.marginal": "JensenShannonDistance",
    "stats.chi_squared_test.marginal": "ChiSquaredTest",
    "stats.feature_corr.joint": "FeatureCorrelation",
    "stats.inv_kl_divergence.marginal": "InverseKLDivergence",
    "stats.ks_test.marginal": "KolmogorovSmirnovTest",
    "stats.max_mean_discrepancy.joint": "MaximumMeanDiscrepancy",
    "stats.wasserstein_dist.joint": "WassersteinDistance",
    "stats.prdc.precision": "PRDCScore",
    "stats.prdc.recall": "PRDCScore",
    "stats.prdc.density": "PRDCScore",
    "stats.prdc.coverage": "PRDCScore",
    "stats.alpha_precision.delta_precision_alpha_OC": "AlphaPrecision",
    "stats.alpha_precision.delta_coverage_beta_OC": "AlphaPrecision",
    "stats.alpha_precision.authenticity_OC": "AlphaPrecision",
    "stats.alpha_precision.delta_precision_alpha_naive": "AlphaPrecision",
    "stats.alpha_precision.delta_coverage_beta_naive": "AlphaPrecision",
    "stats.alpha_precision.authenticity_naive": "AlphaPrecision",
    "stats.survival_km_distance.abs_optimism": "SurvivalKMDistance",
    "performance.linear_model.syn_id": "AugmentationPerformanceEvaluatorLinear",
    "performance.linear_model.syn_ood": "AugmentationPerformanceEvaluatorLinear",
    "performance.mlp.syn_id": "AugmentationPerformanceEvaluatorMLP",
    "performance.mlp.syn_ood": "AugmentationPerformanceEvaluatorMLP",
    "performance.xgb.syn_id": "AugmentationPerformanceEvaluatorXGB",
    "performance.xgb.syn_ood": "AugmentationPerformanceEvaluatorXGB",
    "performance.feat_rank_distance.corr": "FeatureImportanceRankDistance",
    "performance.feat_rank_distance.pvalue": "FeatureImportanceRankDistance",
    "detection.detection_xgb.mean": "SyntheticDetectionXGB",
    "detection.detection_mlp.mean": "SyntheticDetectionMLP",
    "detection.detection_gmm.mean": "SyntheticDetectionGMM",
    "detection.detection_linear.mean": "SyntheticDetectionLinear",
    "privacy.delta-presence.score": "DeltaPresence",
    "privacy.k-anonymization.gt": "kAnonymization",
    "privacy.k-anonymization.syn": "kAnonymization",
    "privacy.k-map.score": "kMap",
    "privacy.distinct l-diversity.gt": "lDiversityDistinct",
    "privacy.distinct l-diversity.syn": "lDiversityDistinct",
    "privacy.identifiability_score.score": "IdentifiabilityScore",
    "privacy.identifiability_score.score_OC": "IdentifiabilityScore",
}
# Evaluator name -> preferred direction in each version.
VERSIONS = ("recorded", "tables", "tables_first")
DIRECTIONS = {
    "DataMismatchScore": ("minimize", "minimize", "minimize"),
    "CommonRowsProportion": ("minimize", "minimize", "minimize"),
    "NearestSyntheticNeighborDistance": ("minimize", "minimize", "minimize"),
    "CloseValuesProbability": ("maximize", "maximize", "maximize"),
    "DistantValuesProbability": ("minimize", "minimize", "minimize"),
    "JensenShannonDistance": ("minimize", "minimize", "minimize"),
    "ChiSquaredTest": ("maximize", "maximize", "maximize"),
    "FeatureCorrelation": ("minimize", "minimize", "minimize"),
    "InverseKLDivergence": ("maximize", "maximize", "minimize"),
    "KolmogorovSmirnovTest": ("maximize", "maximize", "minimize"),
    "MaximumMeanDiscrepancy": ("minimize", "minimize", "minimize"),
    "WassersteinDistance": ("minimize", "minimize", "minimize"),
    "PRDCScore": ("maximize", "maximize", "maximize"),
    "AlphaPrecision": ("maximize", "maximize", "maximize"),
    "SurvivalKMDistance": ("minimize", "minimize", "minimize"),
    "AugmentationPerformanceEvaluatorLinear": ("maximize", "maximize", "maximize"),
    "AugmentationPerformanceEvaluatorMLP": ("maximize", "maximize", "maximize"),
    "AugmentationPerformanceEvaluatorXGB": ("maximize", "maximize", "maximize"),
    "FeatureImportanceRankDistance": ("minimize", "minimize", "minimize"),
    "SyntheticDetectionXGB": ("minimize", "minimize", "minimize"),
    "SyntheticDetectionMLP": ("minimize", "minimize", "minimize"),
    "SyntheticDetectionGMM": ("minimize", "minimize", "minimize"),
    "SyntheticDetectionLinear": ("minimize", "minimize", "minimize"),
    "DeltaPresence": ("maximize", "minimize", "minimize"),
    "kAnonymization": ("maximize", "maximize", "maximize"),
    "kMap": ("maximize", "maximize", "maximize"),
    "lDiversityDistinct": ("maximize", "maximize", "maximize"),
    "IdentifiabilityScore": ("minimize", "minimize", "minimize"),
    "DomiasMIA": ("minimize", "minimize", "minimize"),
    "DomiasMIABNAF": ("minimize", "minimize", "minimize"),
    "DomiasMIAKDE": ("minimize", "minimize", "minimize"),
    "DomiasMIAPrior": ("minimize", "minimize", "minimize"),
    "DataLeakageLinear": ("minimize", "minimize", "minimize"),
    "DataLeakageMLP": ("minimize", "minimize", "minimize"),
    "DataLeakageXGB": ("minimize", "minimize", "minimize"),
}
# The 17 metrics of the comparison tables.
REPORTED = (
    "privacy.delta-presence.score", "privacy.distinct l-diversity.syn", "privacy.k-anonymization.syn",
    "privacy.k-map.score", "sanity.close_values_probability.score", "sanity.nearest_syn_neighbor_distance.mean",
    "stats.alpha_precision.authenticity_naive", "stats.chi_squared_test.marginal",
    "stats.inv_kl_divergence.marginal", "stats.jensenshannon_dist.marginal", "stats.ks_test.marginal",
    "stats.max_mean_discrepancy.joint", "stats.prdc.coverage", "stats.prdc.density", "stats.prdc.precision",
    "stats.prdc.recall", "stats.wasserstein_dist.joint",
)


def direction(metric: str, version: str = "recorded") -> str:
    """Preferred direction of a recorded metric, or of an evaluator by its name (attacks have no recorded metric)."""
    return DIRECTIONS[METRIC_NAMES.get(metric, metric)][VERSIONS.index(version)]


def metric_dimension(spark: SparkSession) -> DataFrame:
    """(metric, short_metric, family, name, direction, direction_version)."""
    rows = [(m, m.split(".", 1)[1], m.split(".", 1)[0], n, direction(m, v), v)
            for m, n in METRIC_NAMES.items() for v in VERSIONS]
    return spark.createDataFrame(rows, "metric string, short_metric string, family string, name string, "
                                       "direction string, direction_version string")


def with_metric_info(results: DataFrame, version: str = "recorded", key: str = "metric") -> DataFrame:
    """Add name, family and direction; ``key`` holds full or short (family-less) names."""
    dim = metric_dimension(results.sparkSession).where(F.col("direction_version") == version)
    full = dim.select(F.col("metric").alias(key), "family", "name", "direction")
    short = dim.select(F.col("short_metric").alias(key), "family", "name", "direction")
    return results.join(F.broadcast(full.unionByName(short)), key, "left")


def metric_parts(metric: Column) -> dict[str, Column]:
    """Family, the rest of the name, and the name without its .syn / .gt suffix."""
    return {"family": F.split(metric, r"\.")[0],
            "short_metric": F.regexp_replace(metric, r"^[^.]*\.", ""),
            "base_metric": F.regexp_replace(metric, r"\.(syn|gt)$", "")}
