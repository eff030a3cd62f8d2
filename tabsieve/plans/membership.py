"""Membership inference end to end: split, members, guard, disjoint slices of the holdout, score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.hashing import seeded_digest
from tabsieve.functions.ranking import number_rows
from tabsieve.operators.attack import domias, membership_scores, membership_tables
from tabsieve.session import materialise

#: Fewest members and holdout rows that are scored.
MIN_MEMBERS, MIN_HOLDOUT = 50, 40
RESULT = ("n_members long, n_nonmembers long, reference_size long, n_cols_dropped int, auroc double, accuracy double, "
          "status string, error string")


def holdout_slices(holdout: DataFrame, id_col: str, size: int, seed: int | str = "slice") -> tuple[DataFrame, DataFrame]:
    """(non-members, reference): two disjoint slices of ``size`` rows each, by digest order of the ids."""
    order = number_rows(holdout.select(id_col, seeded_digest(seed, id_col).alias("_d")), ["_d", id_col], name="_rn")
    placed = materialise(holdout.join(order.select(id_col, "_rn"), id_col))
    return (placed.where(F.col("_rn") <= size).drop("_rn"),
            placed.where((F.col("_rn") > size) & (F.col("_rn") <= 2 * size)).drop("_rn"))


def membership_inference(base: DataFrame, arm: DataFrame, generate: Callable[[DataFrame], DataFrame], id_col: str, syn_id: str,
                         prior: str = "kde", seed: int | str = 42) -> DataFrame:
    """One result row of the density attack on the training rows that ``arm`` kept.

    ``generate`` makes the synthetic table from the members. Tables below the guard give a row with
    status ``too small``, a failed score one with status ``failed`` and its error.
    """
    members, holdout, dropped = membership_tables(base, arm, id_col, seed)
    members, holdout = materialise(members), materialise(holdout)
    n_members, n_holdout = members.count(), holdout.count()
    size = min(n_holdout // 2, n_members)
    row = (n_members, size, size, len(dropped), None, None)
    if n_members < MIN_MEMBERS or n_holdout < MIN_HOLDOUT:
        out = (*row, "too small", None)
    else:
        outsiders, reference = holdout_slices(holdout, id_col, size)
        features = [c for c in members.columns if c != id_col]
        try:
            got = membership_scores(domias(members, outsiders, generate(members), reference, id_col, syn_id, features, prior)).first()
            out = (*row[:4], float(got["auroc"]), float(got["accuracy"]), "ok", None)
        except Exception as e:  # noqa: BLE001 - a failed attack is a result row
            out = (*row, "failed", f"{type(e).__name__}: {e}")
    return base.sparkSession.createDataFrame([out], RESULT)
