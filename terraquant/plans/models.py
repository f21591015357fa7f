"""Linear learners, grid search, metrics, leaderboards and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import metrics, runs, scenario
from ..operators.linear import best_cells, runs as gram_runs
from ..session import materialise
from ..sources import study
from ..sources.tables import FEATURES, KEY, LABEL, TIEBREAK
from .common import clipped, fitted, scored
from .oracle import BASE, FITTED, SCORED, gram, ols, predicted, prep, r, with_
from .registry import query
from .summaries import run_table, runs_sql

WIDE = ["x_qty", "x_disc", "x_total", "x_size", "x_price"]


def coefficient_rows(spark, model):
    rows = [("intercept", model.intercept), *zip(model.features, model.coef, strict=True)]
    return spark.createDataFrame(rows, "term string, value double").select("term", rounded("value").alias("value"))


def coefficient_sql(features, coef="coef") -> str:
    return f"SELECT 'intercept' AS term, {r('b0')} AS value FROM {coef}" + "".join(
        f" UNION ALL SELECT '{f}', {r(f'b{i}')} FROM {coef}" for i, f in enumerate(features, 1)
    )


@query("fit_linear", with_(*BASE, prep(WIDE), ols(WIDE), select=coefficient_sql(WIDE)))
def fit_linear(spark, sf_dir):
    _, model = fitted(spark, sf_dir, features=WIDE)
    return coefficient_rows(spark, model)


@query("fit_ridge", with_(*BASE, prep(WIDE), ols(WIDE, ridge="50"), select=coefficient_sql(WIDE)))
def fit_ridge(spark, sf_dir):
    _, model = fitted(spark, sf_dir, features=WIDE, learner="ridge", alpha=50.0)
    return coefficient_rows(spark, model)


def _soft(rho: str, alpha: float, diagonal: str) -> str:
    return f"sign({rho}) * greatest(abs({rho}) - {alpha}::double, 0) / ({diagonal})"


def lasso_sql(features, alpha: float, sweeps: int = 60) -> list[str]:
    """Coordinate descent as a recursion over one row: each sweep updates the coefficients in turn."""
    p = len(features)
    zs = [f"z{i}" for i in range(1, p + 1)]
    steps = []
    for i in range(1, p + 1):
        rest = [f"a{i}_{j} * {'n' if j < i else 'b'}{j}" for j in range(1, p + 1) if j != i]
        steps.append(f"{_soft(f'((a{i}_{p + 1} - ' + ' - '.join(rest) + ') / n)', alpha, f'a{i}_{i} / n')} AS n{i}")
    return [
        gram(zs, "y", "prepped", "NOT is_test", name="lasso_gram"),
        "descent AS (SELECT 0 AS it, " + ", ".join(f"0.0::double AS b{i}" for i in range(1, p + 1))
        + " UNION ALL SELECT it + 1, " + ", ".join(f"n{i}" for i in range(1, p + 1))
        + f" FROM (SELECT it, {', '.join(steps)} FROM descent CROSS JOIN lasso_gram WHERE it < {sweeps}))",
        f"coef AS (SELECT {', '.join(f'b{i}' for i in range(1, p + 1))}, m{p + 1} - "
        + " - ".join(f"b{i} * m{i}" for i in range(1, p + 1))
        + f" AS b0 FROM descent CROSS JOIN lasso_gram WHERE it = {sweeps})",
    ]


@query("fit_lasso", with_(*BASE, prep(WIDE), *lasso_sql(WIDE, 0.01), select=coefficient_sql(WIDE), recursive=True))
def fit_lasso(spark, sf_dir):
    _, model = fitted(spark, sf_dir, features=WIDE, learner="lasso", alpha=0.01)
    return coefficient_rows(spark, model)


RIDGE_GRID = {"ridge": study.GRIDS["ridge"]["alpha"]}


GRID_SEEDS = 50


@query(
    "grid_search_cv",
    with_(
        *BASE[:3],
        *runs_sql(GRID_SEEDS, RIDGE_GRID),
        select=f"""SELECT c.seed::int AS seed, c.alpha, {r('c.cv_r2', 9)} AS cv_r2, chosen.cell IS NOT NULL AS best
        FROM cv c LEFT JOIN chosen ON chosen.seed = c.seed AND chosen.cell = c.cell""",
    ),
)
def grid_search_cv(spark, sf_dir):
    """All ridge penalties of the comparison grid, fifty seeds, five folds: one aggregate."""
    cells = materialise(gram_runs(clipped(spark, sf_dir, [KEY, *FEATURES]), FEATURES, LABEL, KEY, GRID_SEEDS, RIDGE_GRID), "cells")
    best = best_cells(cells).select("seed", F.col("cell").alias("best_cell"))
    return cells.join(best, "seed").select(
        "seed", "alpha", rounded("cv_r2", 9).alias("cv_r2"), (F.col("cell") == F.col("best_cell")).alias("best")
    )


@query(
    "regression_metrics",
    with_(
        *SCORED,
        select=f"""SELECT is_test, count(*) AS n, {r('1 - sum(power(y - prediction, 2)) / (count(*) * var_pop(y))')} AS r2,
        {r('avg(abs(y - prediction))')} AS mae, {r('sqrt(avg(power(y - prediction, 2)))')} AS rmse FROM scored GROUP BY is_test""",
    ),
)
def regression_metrics(spark, sf_dir):
    rows, _ = scored(spark, sf_dir)
    m = metrics.regression_metrics(rows, LABEL, "prediction", ["is_test"])
    return m.withColumns({c: rounded(c) for c in ("r2", "mae", "rmse")})


BOARD_GRID = {"ols": [0.0], "ridge": study.GRIDS["ridge"]["alpha"]}
BOARD_SEEDS = 50


@query(
    "compare_models",
    with_(
        *BASE[:3],
        *runs_sql(BOARD_SEEDS, BOARD_GRID),
        """board AS (SELECT learner, count(*) AS runs, avg(test_r2) AS mean_r2, stddev_samp(test_r2) AS std_r2,
        avg(test_mae) AS mean_mae, avg(test_rmse) AS mean_rmse FROM run_table GROUP BY learner)""",
        select=f"""SELECT learner, runs, {r('mean_r2')} AS mean_r2, {r('std_r2')} AS std_r2, {r('mean_mae')} AS mean_mae,
        {r('mean_rmse')} AS mean_rmse, row_number() OVER (ORDER BY mean_r2 DESC, learner) AS rank FROM board""",
    ),
)
def compare_models(spark, sf_dir):
    board = runs.compare_models(run_table(spark, sf_dir, BOARD_SEEDS, BOARD_GRID), model="learner")
    return board.withColumns({c: rounded(c) for c in ("mean_r2", "std_r2", "mean_mae", "mean_rmse")})


@query(
    "score",
    with_(*SCORED, select=f"SELECT obs_key, tiebreak, is_test, {r('prediction', 4)} AS prediction FROM scored"),
)
def score(spark, sf_dir):
    """Saved as a Spark ML stage, loaded back, and applied to every row."""
    from pyspark.ml import PipelineModel

    from ..session import fresh_path

    rows, model = fitted(spark, sf_dir)
    path = fresh_path(spark, "linear-model")
    model.as_stage().write().overwrite().save(path)
    scored_rows = scenario.score(PipelineModel.load(path), rows, FEATURES)
    return scored_rows.select(KEY, TIEBREAK, "is_test", rounded("prediction", 4).alias("prediction"))


@query(
    "train_test_predictions",
    with_(
        *SCORED,
        """m AS (SELECT 1 - sum(power(y - prediction, 2)) / (count(*) * var_pop(y)) AS test_r2,
        sqrt(avg(power(y - prediction, 2))) AS test_rmse FROM scored WHERE is_test)""",
        select=f"""SELECT obs_key, tiebreak, is_test, {r('y', 4)} AS observed, {r('prediction', 4)} AS predicted, {r('test_r2')} AS test_r2,
        {r('test_rmse')} AS test_rmse FROM scored CROSS JOIN m""",
    ),
)
def train_test_predictions(spark, sf_dir):
    rows, _ = scored(spark, sf_dir)
    test = metrics.regression_metrics(rows.where(F.col("is_test")), LABEL, "prediction")
    m = test.select(F.struct("r2", "rmse").alias("m")).scalar()
    return rows.select(
        KEY, TIEBREAK, "is_test", rounded(LABEL, 4).alias("observed"), rounded("prediction", 4).alias("predicted"),
        rounded(m["r2"]).alias("test_r2"), rounded(m["rmse"]).alias("test_rmse"),
    )
