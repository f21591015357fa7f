"""Graph-adjusted linear effects and their refutations.

The effect of every treatment of a graph is read from one moment matrix; the three
refuters share one replicated moment aggregate. Effects are plain adjusted slopes
of a fully observed linear model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.hashing import SPACE, Drawn, drawn_text, draws_below
from ..functions.linalg import Moments
from .linear import sum_moments
from .moments import collect_conditioned, conditioned, replicated_moments

EFFECT_SCHEMA = "treatment string, effect double, std_error double, t_stat double, p_value double, ci_low double, ci_high double, n bigint"
REFUTER_SCHEMA = "treatment string, refuter string, rep int, effect double"
NOISE = "__noise"


def adjustment(edges: Sequence[tuple[str, str]], treatment: str) -> list[str]:
    return sorted({s for s, d in edges if d == treatment})


def check_treatments(edges: Sequence[tuple[str, str]], treatments: Sequence[str], outcome: str) -> None:
    allowed = {n for e in edges for n in e} - {outcome}
    unknown = [t for t in treatments if t not in allowed]
    if unknown:
        raise ValueError(f"unknown treatments {unknown}; choose from {sorted(allowed)}")


def graph_features(edges: Sequence[tuple[str, str]], outcome: str) -> list[str]:
    return sorted({n for e in edges for n in e} - {outcome})


def _block(A: np.ndarray, features: Sequence[str], chosen: Sequence[str]) -> np.ndarray:
    keep = [0, *[1 + list(features).index(c) for c in chosen], A.shape[0] - 1]
    return A[np.ix_(keep, keep)]


def effect(A: np.ndarray, features: Sequence[str], treatment: str, given: Sequence[str]) -> float:
    """Slope of the treatment alone."""
    return float(linalg.solve_ridge(_block(A, features, [treatment, *given]))[0][0])


def slope(A: np.ndarray, features: Sequence[str], treatment: str, given: Sequence[str]) -> dict[str, float]:
    """Slope of the treatment with its error, from a second-moment matrix of (1, features, label)."""
    B = _block(A, features, [treatment, *given])
    beta, intercept = linalg.solve_ridge(B)
    n = int(round(B[0, 0]))
    df = n - len(beta) - 1
    C, _ = linalg.covariance(B)
    sse = linalg.squared_error(B, beta, intercept)
    inverse = np.linalg.pinv(C[:-1, :-1])
    error = float(np.sqrt(max(sse / df * inverse[0, 0], 0.0))) if df > 0 else float("nan")
    t = float(beta[0]) / error if error > 0 else float("inf")
    half = linalg.student_quantile(0.975, df) * error if df > 0 else float("nan")
    p = linalg.student_two_sided(t, df) if df > 0 else float("nan")
    return {
        "effect": float(beta[0]), "std_error": error, "t_stat": t, "p_value": p,
        "ci_low": float(beta[0]) - half, "ci_high": float(beta[0]) + half, "n": n,
    }


def prepared_moments(df: DataFrame, features: Sequence[str], outcome: str, scale: bool = False) -> np.ndarray:
    """Second moments of mean-imputed (optionally scaled) features and the outcome, from one pass.

    Coordinates may be shifted to the column means, which leaves slopes unchanged.
    """
    groups, _ = collect_conditioned(df, features, outcome)
    m = groups[()]
    return encode(m, m, scale)


def encode(m: Moments, fitted_on: Moments, scale: bool) -> np.ndarray:
    A = m.second_moments(fitted_on.feature_means())
    return linalg.affine(A, fitted_on.low, fitted_on.high - fitted_on.low) if scale else A


def backdoor_effects(
    df: DataFrame, edges: Sequence[tuple[str, str]], treatments: Sequence[str], outcome: str, scale: bool = False
) -> DataFrame:
    """Adjusted effect of a unit step in each treatment, with its error, p-value and 95% interval."""
    check_treatments(edges, treatments, outcome)
    features = graph_features(edges, outcome)
    A = prepared_moments(df, features, outcome, scale)
    rows = []
    for t in treatments:
        s = slope(A, features, t, adjustment(edges, t))
        rows.append((t, s["effect"], s["std_error"], s["t_stat"], s["p_value"], s["ci_low"], s["ci_high"], s["n"]))
    return df.sparkSession.createDataFrame(rows, EFFECT_SCHEMA)


def refutations(
    df: DataFrame,
    edges: Sequence[tuple[str, str]],
    treatments: Sequence[str],
    outcome: str,
    key: str,
    reps: int = 20,
    subset_fraction: float = 0.8,
    scale: bool = False,
) -> DataFrame:
    """(treatment, refuter, rep, effect) for the three refuters, from one replicated aggregate.

    Each replicate gives every row one keyed uniform draw; no row is copied. As an extra covariate it
    is the random common cause; in the treatment's place it is the placebo; below
    the subset fraction it selects the subset. Imputation stays as fitted on all rows.
    """
    check_treatments(edges, treatments, outcome)
    features = graph_features(edges, outcome)
    drawn, limit = Drawn(drawn_text(key, reps), reps), draws_below(subset_fraction)
    kept = lambda draws: (draws < limit).astype(np.int8)
    noise = lambda draws: draws / float(SPACE) - 0.5
    columns = [*features, NOISE]

    def collect(centres: dict[str, float]) -> dict[tuple, Moments]:
        own = {**centres, "__extra": centres.get(NOISE, 0.0)}
        rows = replicated_moments(df, features, outcome, drawn, (1, 0), kept, noise, own).collect()
        return {(r["rep"], bool(r["code"])): Moments.unpack(r["n"], r["sums"], r["lows"], r["highs"]) for r in rows}

    groups, _ = conditioned(collect, [*columns, outcome])
    rows = []
    for rep in range(reps):
        parts = {kept: groups[(rep, kept)] for kept in (True, False) if (rep, kept) in groups}
        whole = sum_moments(list(parts.values()))
        full = encode(whole, whole, scale)
        for t in treatments:
            given = adjustment(edges, t)
            rows.append((t, "random_common_cause", rep, effect(full, columns, t, [*given, NOISE])))
            rows.append((t, "placebo_treatment", rep, effect(full, columns, NOISE, given)))
            if True in parts:
                subset = encode(parts[True], whole, scale)
                rows.append((t, "data_subset", rep, effect(subset, columns, t, given)))
    return df.sparkSession.createDataFrame(rows, REFUTER_SCHEMA)


# What each refuter's effects are held against: the estimate, or no effect for a placebo.
REFUTERS = {"random_common_cause": True, "placebo_treatment": False, "data_subset": True}


def effect_report(effects: DataFrame, refuted: DataFrame) -> DataFrame:
    """One row per treatment: effect with interval, and per refuter the mean effect, its spread and a p-value.

    The p-value is two-sided and from ranks: how far out the reference lies among the refuter's
    repetitions. A small one speaks against the estimate.
    """
    joined = refuted.join(effects.select("treatment", F.col("effect").alias("estimate")), "treatment")
    reference = F.when(F.col("refuter").isin([k for k, own in REFUTERS.items() if own]), F.col("estimate")).otherwise(0.0)
    below_, above = (F.avg(side.cast("double")) for side in (F.col("effect") <= reference, F.col("effect") >= reference))
    told = joined.groupBy("treatment", "refuter").agg(
        F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("std"), F.least(2 * below_, 2 * above, F.lit(1.0)).alias("p")
    )
    wide = told.groupBy("treatment").agg(
        *[
            F.max(F.when(F.col("refuter") == k, F.col(c))).alias(name)
            for k in REFUTERS
            for c, name in (("mean", k), ("std", f"{k}_std"), ("p", f"{k}_p"))
        ]
    )
    return effects.join(wide, "treatment")
