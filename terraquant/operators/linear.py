"""Least squares, ridge and lasso from aggregated moments.

Fitting costs one aggregate of the training rows. A fitted model is a column
expression over the raw features, so scoring is a map-only projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.hashing import Drawn, draws_below, drawn_text, unpacked_draws
from ..functions.linalg import Moments
from ..session import materialise
from .moments import collect_conditioned, column_means, replicated_moments

RUN_SCHEMA = (
    "seed int, learner string, alpha double, cv_r2 double, test_r2 double, test_rmse double, "
    "n_train bigint, n_test bigint, intercept double, slope array<double>, impute array<double>"
)


@dataclass(frozen=True)
class LinearModel:
    """Imputation, scaling and coefficients of one fitted linear learner."""

    features: tuple[str, ...]
    impute: tuple[float, ...]
    low: tuple[float, ...]
    span: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float

    def imputed(self, feature: str) -> Column:
        return F.coalesce(F.col(feature).cast("double"), F.lit(self.impute[self.features.index(feature)]))

    def encoded(self, feature: str) -> Column:
        """The feature as the learner sees it: mean-imputed, then min-max scaled."""
        i = self.features.index(feature)
        if self.span[i] == 0:
            return F.lit(0.0)
        return (self.imputed(feature) - F.lit(self.low[i])) / F.lit(self.span[i])

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for f, b in zip(self.features, self.coef, strict=True):
            out = out + F.lit(b) * self.encoded(f)
        return out

    def as_stage(self, prediction: str = "prediction") -> PipelineModel:
        """The model as a saveable Spark ML stage (one SQL projection)."""
        terms = [repr(self.intercept)]
        for i, f in enumerate(self.features):
            if self.span[i] != 0:
                terms.append(
                    f"{self.coef[i]!r}D * (coalesce(cast(`{f}` as double), {self.impute[i]!r}D)"
                    f" - {self.low[i]!r}D) / {self.span[i]!r}D"
                )
        terms[0] += "D"
        return PipelineModel([SQLTransformer(statement=f"SELECT *, {' + '.join(terms)} AS {prediction} FROM __THIS__")])


def solve(
    train: Moments, learner: str, alpha: float, scale: bool = True
) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients on encoded features from training moments: (beta, intercept, impute, low, span)."""
    impute = train.feature_means()
    low = train.low if scale else np.zeros_like(impute)
    span = train.high - train.low if scale else np.ones_like(impute)
    low, span = np.nan_to_num(low), np.nan_to_num(span)
    A = linalg.affine(train.second_moments(impute), low, span)
    beta, intercept = _solve_encoded(A, learner, alpha)
    return beta, intercept, impute, low, span


def _solve_encoded(A: np.ndarray, learner: str, alpha: float) -> tuple[np.ndarray, float]:
    if learner == "lasso":
        return linalg.solve_lasso(A, alpha)
    return linalg.solve_ridge(A, alpha if learner == "ridge" else 0.0)


def fit(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    learner: str = "ols",
    alpha: float = 0.0,
    scale: bool = True,
) -> LinearModel:
    """Fit one model on all rows of ``train``; preprocessing is fitted on the same rows."""
    if learner not in ("ols", "ridge", "lasso"):
        raise ValueError(f"unknown linear learner {learner!r}")
    groups, centres = collect_conditioned(train, features, label)
    return model_from_moments(groups[()], centres, features, label, learner, alpha, scale)


def model_from_moments(
    m: Moments,
    centres: dict[str, float],
    features: Sequence[str],
    label: str,
    learner: str = "ols",
    alpha: float = 0.0,
    scale: bool = True,
) -> LinearModel:
    beta, intercept, impute, low, span = solve(m, learner, alpha, scale)
    shift = np.array([centres.get(f, 0.0) for f in features])
    # Back from centred coordinates; unscaled fits keep low = 0 and absorb the shift in the intercept.
    if scale:
        low = low + shift
    else:
        intercept -= float(beta @ shift)
    return LinearModel(
        tuple(features),
        tuple(float(v) for v in impute + shift),
        tuple(float(v) for v in low),
        tuple(float(v) for v in span),
        tuple(float(v) for v in beta),
        float(intercept + centres.get(label, 0.0)),
    )


def runs(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    seeds: int,
    grid: dict[str, Sequence[float]],
    folds: int = 5,
    test_fraction: float = 0.3,
    scope: str = "train",
    centres: dict[str, float] | None = None,
) -> DataFrame:
    """Every seed x learner x alpha, cross-validated and refitted, from one aggregate.

    ``grid`` maps a learner to its alphas. All seeds and folds share one scan: a task
    multiplies each batch with the parts of all seeds, the moments of a training fold are the training
    total minus that fold's, and test error follows from the test part's moments.
    ``scope="train"`` fits imputation and scaling on the whole training part before
    cross-validation; ``scope="fold"`` refits them inside each fold.
    Returns all grid cells with columns ``cell`` (grid order) and RUN_SCHEMA.
    """
    centres = column_means(df, [*features, label]) if centres is None else centres
    limit = draws_below(test_fraction)
    cells = [(learner, float(a)) for learner, alphas in grid.items() for a in alphas]
    shift = np.array([centres.get(f, 0.0) for f in features])
    label_shift = centres.get(label, 0.0)

    def one_seed(pdf):
        import pandas as pd

        pieces = {int(r.part): Moments.unpack(r.n, r.sums, r.lows, r.highs) for r in pdf.itertuples()}
        test = pieces.get(-1)
        fold_parts = {k: v for k, v in pieces.items() if k >= 0}
        train = sum_moments(list(fold_parts.values()))
        out = []
        for i, (learner, alpha) in enumerate(cells):
            beta, intercept, impute, low, span = solve(train, learner, alpha)
            scores = []
            for k, held in fold_parts.items():
                rest = [v for j, v in fold_parts.items() if j != k]
                if not rest:
                    continue
                fit_on = sum_moments(rest)
                if scope == "fold":
                    b, c, imp, lo, sp = solve(fit_on, learner, alpha)
                else:
                    imp, lo, sp = impute, low, span
                    b, c = _solve_encoded(linalg.affine(fit_on.second_moments(imp), lo, sp), learner, alpha)
                scores.append(linalg.r_squared(linalg.affine(held.second_moments(imp), lo, sp), b, c))
            slope = np.divide(beta, span, out=np.zeros_like(beta), where=span > 0)
            raw_intercept = intercept + label_shift - float(slope @ (low + shift))
            test_r2 = test_rmse = None
            if test is not None:
                T = linalg.affine(test.second_moments(impute), low, span)
                test_r2 = linalg.r_squared(T, beta, intercept)
                test_rmse = (linalg.squared_error(T, beta, intercept) / test.n) ** 0.5
            out.append(
                (i, int(pdf["seed"].iloc[0]), learner, alpha, float(np.mean(scores)) if scores else None, test_r2,
                 test_rmse, int(train.n), int(test.n) if test is not None else 0, raw_intercept, slope.tolist(),
                 (impute + shift).tolist())
            )
        return pd.DataFrame(out, columns=["cell", *[c.split()[0] for c in RUN_SCHEMA.split(", ")]])

    part = lambda draws: np.where(draws < limit, -1, (draws % np.uint32(folds)).astype(np.int16))
    gram = replicated_moments(df, features, label, Drawn(drawn_text(key, seeds), seeds), range(-1, folds), part, centres=centres)
    gram = gram.withColumnsRenamed({"rep": "seed", "code": "part"})
    return gram.groupBy("seed").applyInPandas(one_seed, f"cell int, {RUN_SCHEMA}")


def sum_moments(parts: list[Moments]) -> Moments:
    out = parts[0]
    for m in parts[1:]:
        out = out + m
    return out


def best_cells(cells: DataFrame) -> DataFrame:
    """Per seed and learner the cell with the highest cross-validated R2; the earlier cell on ties."""
    others = [c for c in cells.columns if c not in ("seed", "learner")]
    best = F.max_by(F.struct(*others), F.struct(F.col("cv_r2"), -F.col("cell")))
    return cells.groupBy("seed", "learner").agg(best.alias("b")).select("seed", "learner", "b.*")


def with_test_mae(
    best: DataFrame, df: DataFrame, features: Sequence[str], label: str, key: str, seeds: int, test_fraction: float = 0.3
) -> DataFrame:
    """Add the held-out mean absolute error: one more scan for all seeds and learners.

    The chosen models, one a seed and learner, are written, since they are also the result, and reach the
    tasks as matrices; a batch of rows is multiplied with all of them at once, so rows are not copied for seeds.
    """
    best = materialise(best, "chosen-runs")
    models = best.select("seed", "learner", "intercept", "slope", "impute").collect()
    slope = np.array([m["slope"] for m in models], float).reshape(len(models), len(features))
    fill = np.nan_to_num(np.array([m["impute"] for m in models], float).reshape(slope.shape)) * slope
    intercept, seed_of = np.array([m["intercept"] for m in models], float), np.array([m["seed"] for m in models], int)
    limit = draws_below(test_fraction)
    rows = df.select(drawn_text(key, seeds).alias("__draws"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate([*features, label])])

    def run(batches):
        import pyarrow as pa

        total, count = np.zeros(len(models)), np.zeros(len(models), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            drawn, known = unpacked_draws(batch.column(0), seeds)
            inside = ((drawn < limit) & known[:, None])[:, seed_of]
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            x, y = values[:, :-1], values[:, -1:]
            missing = np.isnan(x)
            error = np.abs(y - (intercept + np.where(missing, 0.0, x) @ slope.T + missing @ fill.T))
            total += np.where(inside, error, 0.0).sum(axis=0)
            count += inside.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(total), pa.array(count)], ["model", "total", "n"])

    sums = rows.mapInArrow(run, "model long, total double, n long").groupBy("model").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    names = df.sparkSession.createDataFrame([(i, m["seed"], m["learner"]) for i, m in enumerate(models)], "model long, seed int, learner string")
    mae = sums.join(names, "model").select("seed", "learner", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("test_mae"))
    return best.join(mae, ["seed", "learner"], "left")
