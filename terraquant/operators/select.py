"""Feature ranking and forward selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..session import materialise
from .linear import sum_moments
from .moments import collect_conditioned
from .reshape import _stack, normalise_share, rank_desc, t_confidence_interval

FOLD_SCHEMA = "rank bigint, feature string, fold int, r2 double"


def univariate_importance(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, importance): share of label variance each feature explains alone, in one pass.

    The few resulting rows are written once, since rankings, shares and curves all read them.
    """
    rows = [F.struct(F.lit(f).alias("feature"), F.regr_r2(label, f).alias("importance")) for f in features]
    return materialise(_stack(df, rows), "importance")


def prefix_fold_scores(df: DataFrame, ranked: Sequence[str], label: str, fold: str) -> DataFrame:
    """(rank, feature, fold, r2) of least squares on every prefix of a feature ranking.

    All prefixes and folds come from one aggregate: the moments of a prefix are a
    leading block of the full moments, and a training fold is the total minus the
    held fold. Imputation and scaling are fitted on the whole table first.
    """
    groups, _ = collect_conditioned(df, ranked, label, [fold])
    parts = {k[0]: m for k, m in groups.items()}
    total = sum_moments(list(parts.values()))
    impute = total.feature_means()
    span = total.high - total.low
    encoded = {k: linalg.affine(m.second_moments(impute), total.low, span) for k, m in parts.items()}
    whole = sum(encoded.values())
    out = []
    for i, feature in enumerate(ranked, 1):
        keep = np.array([*range(i + 1), len(ranked) + 1])
        block = np.ix_(keep, keep)
        for k, held in sorted(encoded.items()):
            beta, intercept = linalg.solve_ridge((whole - held)[block])
            out.append((i, feature, int(k), linalg.r_squared(held[block], beta, intercept)))
    return df.sparkSession.createDataFrame(out, FOLD_SCHEMA)


def selection_curve(importance: DataFrame, fold_scores: DataFrame) -> DataFrame:
    """(rank, feature, importance share, fold scores, mean R2, 95% interval) per prefix."""
    ci = t_confidence_interval(fold_scores, ["rank", "feature"], "r2")
    folds = fold_scores.groupBy("rank", "feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "r2"))), lambda x: x["r2"]).alias("fold_r2")
    )
    used = importance.join(ci.select("feature"), "feature", "left_semi")
    shares = normalise_share(used, "importance")
    return (
        ci.withColumnRenamed("mean", "mean_r2")
        .join(folds, ["rank", "feature"])
        .join(shares.select("feature", "share"), "feature")
        .select("rank", "feature", "share", "fold_r2", "mean_r2", "ci_low", "ci_high")
    )


def forward_prefix_cv(train: DataFrame, features: Sequence[str], label: str, fold: str, top: int = 20) -> DataFrame:
    """Rank features, take the top ones, and score every prefix of the ranking."""
    importance = univariate_importance(train, features, label)
    ranked = rank_desc(importance, "importance", "feature").where(F.col("rank") <= top)
    names = [r["feature"] for r in ranked.orderBy("rank").collect()]
    return selection_curve(importance, prefix_fold_scores(train, names, label, fold))


def choose_prefix(curve: DataFrame, n: int) -> DataFrame:
    return curve.where(F.col("rank") <= n)
