"""End-to-end sanitisers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.operators.centre import centre_distances, geometric_medians
from tabsieve.operators.dbscan import dbscan
from tabsieve.operators.diagnose import removal_audit
from tabsieve.operators.encode import category_mapping, columns_of_type, impute_most_frequent, ordinal_decode, ordinal_encode
from tabsieve.operators.filters import split_noise, stratified_trim, threshold_split
from tabsieve.operators.scale import standardise
from tabsieve.operators.search import capped_search, choose, relative_eps
from tabsieve.session import materialise
from tabsieve.sources.stages import StageStore
from tabsieve.spec import TableSpec


# Default eps fractions of the capped search.
FRACTIONS = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0, 1.2)


@dataclass
class Sanitised:
    table: DataFrame | None
    search: DataFrame
    chosen: DataFrame
    audit: DataFrame | None
    status: str


def encode_table(df: DataFrame, spec: TableSpec, impute: bool = True) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """(encoded table, mapping, feature columns); the target is a feature like any other."""
    features = list(spec.features) or [c for c in df.columns if c != spec.row_id]
    work = df.select(spec.row_id, *dict.fromkeys([*features, *([spec.target] if spec.target else [])]))
    if impute:
        work = impute_most_frequent(work, [c for c in work.columns if c != spec.row_id])
    cats = [c for c in columns_of_type(work, "categorical") if c != spec.row_id]
    mapping = category_mapping(work, cats) if cats else None
    return (ordinal_encode(work, mapping) if cats else work), mapping, features


def capped_sanitiser(df: DataFrame, spec: TableSpec, fractions: Sequence[float] | None = None,
                     eps_values: Sequence[float] | None = None, min_samples: Sequence[int] = (3, 5, 8, 10, 15, 20, 30, 45),
                     tau: float = 0.10, impute: bool = True, min_kept_share: float | None = 0.4,
                     min_kept: int | None = None, store: StageStore | None = None, pairs: int = 1200, seed: int = 0) -> Sanitised:
    """Search the grid, keep the best configuration that meets the class cap, return its raw rows.

    Eps values default to twelve fractions of the median distance between ``pairs`` drawn rows.
    """
    spec.validate(df)
    encoded, _, features = encode_table(df, spec, impute)
    encoded = materialise(encoded)
    if eps_values is None:
        z = standardise(encoded, features)
        eps_values = relative_eps(z, spec.row_id, [f"z_{c}" for c in features], fractions or FRACTIONS, pairs, seed)
    configs = [(e, m) for e in eps_values for m in min_samples]
    search, kept = capped_search(encoded, spec.row_id, features, spec.target, configs, tau, min_kept_share, min_kept)
    search = materialise(search)
    chosen = materialise(choose(search))
    best = chosen.first()
    if best is None:
        return Sanitised(None, search, chosen, None, "no admissible configuration")
    ids = kept[0]
    for part in kept[1:]:
        ids = ids.unionByName(part)
    ids = ids.where(F.col("config") == best["config"]).select(spec.row_id)
    table = df.join(ids, spec.row_id, "left_semi").select(*df.columns)
    audit = removal_audit(df, table, spec.target, tau)
    if store is not None:
        store.write(table, 5)
        store.write_config(chosen)
    return Sanitised(table, search, chosen, audit, "ok")


def label_and_measure(df: DataFrame, id_col: str, features: Sequence[str], eps: float, min_samples: int,
                      metric: str = "euclidean", variant: str = "plain", max_iter: int = 400,
                      weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members with cluster and distance, noise rows) of one configuration over raw numeric columns."""
    z = materialise(standardise(df, features))
    zcols = [f"z_{c}" for c in features]
    labelled = materialise(dbscan(z, id_col, zcols, [(eps, min_samples)], metric).drop("config_id", *zcols))
    members, noise = split_noise(labelled)
    centres = materialise(geometric_medians(members, features, ["cluster"], variant, max_iter=max_iter))
    return centre_distances(members, centres, features, ["cluster"], weights), noise


def trimmed_strata(df: DataFrame, id_col: str, features: Sequence[str], target: str, eps: float, min_samples: int,
                   tau: float = 0.10) -> DataFrame:
    """Kept and removed rows per (cluster, class); noise appears as cluster -1 with nothing kept."""
    far, noise = label_and_measure(df, id_col, features, eps, min_samples)
    far = materialise(far)
    kept = stratified_trim(far, tau, ["cluster", target]).select(id_col).withColumn("_k", F.lit(1))
    rows = far.select(id_col, "cluster", target).unionByName(noise.select(id_col, F.lit(-1).alias("cluster"), target))
    return (rows.join(kept, id_col, "left").groupBy("cluster", target)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("_k").alias("kept"))
            .withColumn("removed", F.col("n_rows") - F.col("kept")))


def threshold_sanitiser(df: DataFrame, spec: TableSpec, eps: float, min_samples: int, thresholds: DataFrame,
                        metric: str = "euclidean", max_iter: int = 400, weights: dict[str, float] | None = None,
                        on_missing: str = "drop", store: StageStore | None = None) -> DataFrame:
    """Encode, cluster, drop noise, cut each cluster at a given distance, decode."""
    spec.validate(df)
    encoded, mapping, features = encode_table(df, spec)
    encoded = materialise(encoded)
    far, noise = label_and_measure(encoded, spec.row_id, features, eps, min_samples, metric, "vardi_zhang", max_iter, weights)
    far = materialise(far)
    kept, outliers = threshold_split(far, thresholds, on_missing)
    plain = kept.drop("cluster", "distance")
    decoded = ordinal_decode(plain, mapping) if mapping is not None else plain
    if store is not None:
        for stage, table in ((1, encoded), (2, far.drop("distance")), (3, noise), (4, far), (5, kept), (6, outliers),
                             (7, plain), (8, decoded)):
            store.write(table, stage)
        if mapping is not None:
            store.write_mapping(mapping)
    return decoded
