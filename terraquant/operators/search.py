"""Run tables over learners and seeds, final model selection and its artefacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import below, seed_bits, seed_hex
from ..session import materialise
from . import knn as knn_ops
from . import linear, metrics, prep, runs, trees

RUN_TABLE = (
    "model string, seed int, cv_r2 double, test_r2 double, test_mae double, test_rmse double, "
    "params map<string,string>, importance map<string,double>"
)
LINEAR = ("ols", "ridge", "lasso")


def seed_parts(df: DataFrame, key: str, seed: int, folds: int, test_fraction: float = 0.3) -> DataFrame:
    """Adds ``is_test`` and the training fold of one seed; the same parts the replicated runs use."""
    return df.withColumn("is_test", below(seed_hex(seed, key), test_fraction)).withColumn(
        "fold", F.pmod(seed_bits(seed, key), F.lit(folds)).cast("int")
    )


def linear_run_table(
    df: DataFrame, features: Sequence[str], label: str, key: str, seeds: int, grid: Mapping[str, Sequence[float]], folds: int = 5
) -> DataFrame:
    """Run table of the linear family: every seed, learner and penalty from one aggregate and one scoring scan."""
    best = linear.best_cells(linear.runs(df, features, label, key, seeds, dict(grid), folds))
    scored = linear.with_test_mae(best, df, features, label, key, seeds)
    return scored.select(
        F.col("learner").alias("model"), "seed", "cv_r2", "test_r2", "test_mae", "test_rmse",
        F.create_map(F.lit("alpha"), F.col("alpha").cast("string")).alias("params"),
        F.lit(None).cast("map<string,double>").alias("importance"),
    )


def tree_run_table(
    df: DataFrame, features: Sequence[str], label: str, key: str, seeds: Sequence[int], kind: str, grid: Mapping[str, Sequence], folds: int = 5,
    parallelism: int = 4,
) -> DataFrame:
    """Run table of a tree learner: a cross-validated search and a refit per seed.

    The prepared table is written once to the shared folder, so every fit reads the
    same narrow files.
    """
    spark = df.sparkSession
    base = materialise(df.select(key, *features, label), "run-input")
    rows = []
    for seed in seeds:
        parts = seed_parts(base, key, seed, folds)
        cells, scores, model = trees.grid_search_trees(
            parts.where(~F.col("is_test")), features, label, kind, grid, "fold", folds, seed, parallelism
        )
        best = max(range(len(cells)), key=lambda i: (scores[i], -i))
        test = trees.predictions(model, parts.where(F.col("is_test")))
        m = metrics.regression_metrics(test, label, "prediction").first()
        rows.append(
            (kind, int(seed), float(scores[best]), m["r2"], m["mae"], m["rmse"], {k: str(v) for k, v in cells[best].items()},
             trees.importances(model, features))
        )
    return spark.createDataFrame(rows, RUN_TABLE)


def knn_run_table(
    df: DataFrame, features: Sequence[str], label: str, key: str, seeds: Sequence[int], grid: Mapping[str, Sequence], folds: int = 5
) -> DataFrame:
    """Run table of nearest-neighbour regression: the whole grid shares one neighbour search per fold and distance."""
    spark = df.sparkSession
    base = materialise(df.select(key, *features, label), "run-input")
    rows = []
    for seed in seeds:
        parts = seed_parts(base, key, seed, folds)
        stats = prep.fit_preprocessing(parts, features, train=~F.col("is_test"))
        encoded = materialise(knn_ops.vectors(prep.apply_preprocessing(parts, stats, features), features), "knn-encoded")
        train = encoded.where(~F.col("is_test"))

        def scores(fit_on: DataFrame, held: DataFrame) -> dict[tuple, tuple]:
            grid_predictions = knn_ops.knn_grid(fit_on, held, key, label, grid["k"], grid["weights"], grid["p"])
            m = metrics.regression_metrics(held.join(grid_predictions, "v"), label, "prediction", ["k", "weights", "p"])
            return {(r["k"], r["weights"], r["p"]): (r["r2"], r["mae"], r["rmse"]) for r in m.collect()}

        per_fold = [scores(train.where(F.col("fold") != f), train.where(F.col("fold") == f)) for f in range(folds)]
        order = [(k, w, p) for k in grid["k"] for w in grid["weights"] for p in grid["p"]]
        cv = {c: sum(s[c][0] for s in per_fold) / folds for c in order}
        best = max(order, key=lambda c: (cv[c], -order.index(c)))
        test = scores(train, encoded.where(F.col("is_test")))[best]
        rows.append(("knn", int(seed), cv[best], *test, dict(zip(("k", "weights", "p"), map(str, best), strict=True)), None))
    return spark.createDataFrame(rows, RUN_TABLE)


def choose_run(run_table: DataFrame, rule: str = "typical") -> DataFrame:
    """The run to keep per model: ``typical`` (held-out R2 nearest the mean, the study's rule) or ``max_cv``."""
    if rule == "typical":
        return runs.closest_to_mean_run(run_table)
    if rule == "max_cv":
        return runs.best_cv_run(run_table)
    raise ValueError(f"unknown rule {rule!r}")


def metadata(chosen, features: Sequence[str], target: str, low: float, high: float, folds: int, test_fraction: float = 0.3) -> dict:
    """Metadata record of a final model, in the artefact schema."""
    return {
        "chosen_run": chosen["seed"] + 1,
        "random_state": chosen["seed"],
        "split": (1.0 - test_fraction, test_fraction),
        "cv": folds,
        "metrics": (chosen["test_r2"], chosen["test_mae"], chosen["test_rmse"]),
        "best_params": dict(chosen["params"] or {}),
        "selected_features": list(features),
        "target": target,
        "clip_quantiles": (low, high),
    }
