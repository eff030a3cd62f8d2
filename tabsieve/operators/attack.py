"""Attribute-inference and membership-inference attacks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.ranking import exact_quantiles
from tabsieve.functions.vectors import total
from tabsieve.operators.cells import cell_columns, count_cells, exact_thresholds, forest_predictions
from tabsieve.operators.diagnose import majority_share
from tabsieve.operators.encode import encode_against, row_key, shared_label_codes
from tabsieve.operators.filters import constant_columns, duplicate_columns, known_label_rows
from tabsieve.operators.generate import split_train_holdout
from tabsieve.operators.neighbours import kernel_sums, prepare, to_rows
from tabsieve.operators.scale import covariance, whiten
from tabsieve.operators.utility import accuracy_scores, assemble, auroc_by_ranks, folded, predictions
from tabsieve.session import in_few_tasks, materialise

RESULT = ("attribute string, n_classes long, baseline double, degenerate boolean, model string, acc double, "
          "bal_acc double, advantage double, error string")


def attack_model(name: str, n_rows: int, n_features: int, n_classes: int, seed: int = 42, trees: int = 200,
                 depth: int = 20, max_iter: int = 1000):
    if name in ("logreg", "linear"):
        # an L2 penalty of one per row, on unscaled columns
        return LogisticRegression(maxIter=max_iter, regParam=1.0 / max(n_rows, 1), standardization=False)
    if name == "rf":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 32, n_classes], maxIter=100, seed=seed)
    if name == "xgb":
        boosted = GBTClassifier(maxIter=20, maxDepth=5, seed=seed)
        return boosted if n_classes == 2 else OneVsRest(classifier=boosted)
    raise ValueError(name)


def degenerate_rows(real: DataFrame, syn: DataFrame, column: str) -> DataFrame:
    """The attack row when the attribute is constant in the synthetic table (guessing), else none.

    ``n_classes`` and the baseline come from all real rows.
    """
    share = majority_share(real, column)
    values = syn.where(F.col(column).isNotNull()).select(column).distinct()
    kinds = values.limit(2).count()
    if kinds >= 2:
        return share.where(F.lit(False)).select(*_guess(column))
    return share.select(*_guess(column))


def _guess(column: str):
    return [F.lit(column).alias("attribute"), F.col("n_classes").cast("long").alias("n_classes"),
            F.round("baseline", 4).alias("baseline"), F.lit(True).alias("degenerate"), F.lit("n/a").alias("model"),
            F.round("baseline", 4).alias("acc"), F.round(1 / F.col("n_classes"), 4).alias("bal_acc"),
            F.lit(0.0).alias("advantage")]


def attribute_inference(real: DataFrame, syn: DataFrame, column: str, models: Sequence[str] = ("logreg", "rf"),
                        seed: int = 42, **sizes) -> DataFrame:
    """Fit on all synthetic rows, predict ``column`` on all real rows: one result row per model.

    Categories of the other columns are coded by the real table; accuracy covers
    real rows whose class occurs in the synthetic table, the baseline all real rows.
    """
    spark = real.sparkSession
    share = majority_share(real, column).first()
    n_real_classes, baseline = share["n_classes"], round(float(share["baseline"]), 4)
    guess = degenerate_rows(real, syn, column)
    if not guess.isEmpty():
        return guess.withColumn("error", F.lit(None).cast("string"))
    others = [c for c in real.columns if c != column]

    def ready(df):
        coded = shared_label_codes(syn, df.select(*others, column), column, name="label").drop(column)
        return encode_against(coded, real.select(*others))

    train, test = materialise(ready(syn)), materialise(known_label_rows(ready(real)))
    facts = train.agg(F.max("label"), F.count(F.lit(1))).first()
    n_classes, n_train = int(facts[0]) + 1, facts[1]
    thresholds = [exact_thresholds(train, c) for c in others] if {"rf", "xgb"} & set(models) else []
    rows = []
    for name in models:
        try:
            got = accuracy_scores(_attacked(name, train, test, others, n_train, n_classes, thresholds, seed, sizes), weight="n").first()
            acc, bal = (round(float(got[k] or 0.0), 4) for k in ("acc", "bal_acc"))
            rows.append((column, n_real_classes, baseline, False, name, acc, bal, round(acc - baseline, 4), None))
        except Exception as e:  # noqa: BLE001 - a failed fit is a result row
            rows.append((column, n_real_classes, baseline, False, name, None, None, None, type(e).__name__))
    return spark.createDataFrame(rows, RESULT)


def _attacked(name: str, train: DataFrame, test: DataFrame, features: Sequence[str], n_train: int, n_classes: int,
              thresholds: Sequence[Sequence[float]], seed: int, sizes: dict) -> DataFrame:
    """(label, prediction, n) of one model. Trees see rows as cells between thresholds, other models as they are, equal rows as one where weighted."""
    model = attack_model(name, n_train, len(features), n_classes, seed, **sizes)
    if name == "mlp":
        return predictions(model.fit(assemble(train, features, "label")), test, features)
    names = [f"_x{j}" for j in range(len(features))]
    if name in ("logreg", "linear"):
        rows = materialise(folded(train, features, "label", False))
        return predictions(model.setWeightCol("n").fit(assemble(in_few_tasks(rows, rows.count()), names, "label", "n")), test, features)
    cells = [f"_c{j}" for j in range(len(features))]
    seen, met = (materialise(count_cells(df, features, thresholds)) for df in (train, test))
    if name == "rf":
        found = forest_predictions(seen, met, len(features), n_classes, model.getNumTrees(), model.getMaxDepth(), seed)
        if found is not None:
            return found
        # draws with replacement are of rows, so MLlib gets every row
        fitted = model.fit(assemble(train.select(*cell_columns(features, thresholds), "label"), cells, "label"))
    else:
        fitted = model.setWeightCol("n").fit(assemble(in_few_tasks(seen, seen.count()), cells, "label", "n"))
    return fitted.transform(assemble(met, cells, "label", "n")).select("label", "prediction", "n")


def membership_tables(base: DataFrame, arm: DataFrame, id_col: str, seed: int | str = 42,
                      share: float = 0.7) -> tuple[DataFrame, DataFrame, list[str]]:
    """(members, holdout, dropped columns): members are training rows the arm kept.

    Constant and near-copied columns of the base table carry no signal and would
    make a covariance singular, so both sides lose them.
    """
    features = [c for c in base.columns if c != id_col]
    parts = split_train_holdout(base, id_col, share, seed)
    kept = row_key(arm, features).select("row_key").distinct()
    members = row_key(parts.where(F.col("part") == "train").drop("part"), features).join(kept, "row_key", "left_semi").drop("row_key")
    holdout = parts.where(F.col("part") == "holdout").drop("part")
    flat = constant_columns(base, features)
    dropped = flat + duplicate_columns(base.select(*[c for c in features if c not in flat]))
    return members.drop(*dropped), holdout.drop(*dropped), dropped


def _density(queries: DataFrame, support: DataFrame, id_col: str, support_id: str, features: Sequence[str], name: str) -> DataFrame:
    """(id, name): Gaussian kernel density with the support's covariance and Scott's bandwidth."""
    n, d = support.count(), len(features)
    cov = covariance(support, features) * (n / (n - 1.0))
    h2 = n ** (-2.0 / (d + 4))
    axes = [f"m_{j}" for j in range(d)]
    white = whiten(queries, features, cov, strict=True).select(id_col, *axes)
    q_points, q = prepare(white, id_col, axes)
    _, s = prepare(whiten(support, features, cov, strict=True).select(support_id, *axes), support_id, axes)
    norm = n * math.sqrt((2 * math.pi * h2) ** d * float(np.linalg.det(cov)))
    return to_rows(white, id_col, axes, q_points, kernel_sums(q, s, 0.5 / h2).select("pid", (F.col("total") / norm).alias(name)))


def domias(members: DataFrame, outsiders: DataFrame, synthetic: DataFrame, reference: DataFrame, id_col: str,
           syn_id: str, features: Sequence[str], prior: str = "kde") -> DataFrame:
    """(id, member, score): p_syn(x) / p_ref(x).

    ``kde`` takes the denominator from a kernel density over the reference rows,
    ``gaussian`` from one Gaussian with the reference mean and covariance. Ids of
    members and outsiders must not overlap. A singular covariance raises.
    """
    if prior not in ("kde", "gaussian"):
        raise ValueError(prior)
    rows = materialise(members.select(id_col, *features).withColumn("member", F.lit(1)).unionByName(
        outsiders.select(id_col, *features).withColumn("member", F.lit(0))))
    top = _density(rows, synthetic, id_col, syn_id, features, "p_syn")
    if prior == "kde":
        low = _density(rows, reference, id_col, id_col, features, "p_ref")
    else:
        low = _gaussian_density(rows, reference, id_col, features, "p_ref")
    return (rows.select(id_col, "member").join(top, id_col).join(low, id_col)
            .withColumn("score", F.col("p_syn") / (F.col("p_ref") + F.lit(1e-10))).select(id_col, "member", "score"))


def _gaussian_density(rows: DataFrame, reference: DataFrame, id_col: str, features: Sequence[str], name: str) -> DataFrame:
    n = reference.count()
    mean = list(reference.agg(*[F.avg(c).alias(c) for c in features]).first())
    cov = covariance(reference, features) * (n / (n - 1.0))
    centred = rows.select(id_col, *[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(features, mean)])
    white = whiten(centred, features, cov, strict=True)
    quad = total([F.col(f"m_{j}") * F.col(f"m_{j}") for j in range(len(features))])
    norm = math.sqrt((2 * math.pi) ** len(features) * float(np.linalg.det(cov)))
    return white.select(id_col, (F.exp(-quad / 2) / F.lit(norm)).alias(name))


def membership_scores(scored: DataFrame) -> DataFrame:
    """(auroc, accuracy, n_pos, n_neg): accuracy calls everything above the median score a member."""
    median = exact_quantiles(scored, [], "score", [0.5], ["m"]).first()["m"]
    auc = auroc_by_ranks(scored, "score", "member").first()
    hit = F.when((F.col("score") > F.lit(median)) == (F.col("member") == 1), 1.0).otherwise(0.0)
    return scored.agg(F.lit(auc["auroc"]).alias("auroc"), F.avg(hit).alias("accuracy"),
                      F.lit(auc["n_pos"]).alias("n_pos"), F.lit(auc["n_neg"]).alias("n_neg"))
