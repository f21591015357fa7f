"""Tree learners on Spark ML.

Four boosted-tree scripts of the study (gradient boosting, XGBoost, LightGBM,
CatBoost) are one learner here with the parameters they share; leaf counts and leaf
penalties have no counterpart. Extra-Trees is approximated by a forest without
bootstrap: its thresholds are optimised over a random feature subset, not drawn at
random. Splits are on binned features, as always in Spark ML.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame

from ..session import shared_dir

KINDS = {
    "decision_tree": "decision_tree", "random_forest": "random_forest", "extra_trees": "extra_trees", "gbt": "gbt",
    "gradient_boosting": "gbt", "xgboost": "gbt", "lightgbm": "gbt", "catboost": "gbt",
}


def _regressor(kind: str, label: str, seed: int, params: Mapping):
    common = dict(featuresCol="__features", labelCol=label, seed=seed)
    family = KINDS[kind]
    if family == "decision_tree":
        stage = DecisionTreeRegressor(**common)
    elif family == "random_forest":
        stage = RandomForestRegressor(**common)
    elif family == "extra_trees":
        stage = RandomForestRegressor(**common, bootstrap=False)
    else:
        stage = GBTRegressor(**common)
    for name, value in params.items():
        stage = stage._set(**{name: value})
    return stage


def tree_pipeline(features: Sequence[str], label: str, kind: str, seed: int = 0, **params) -> Pipeline:
    """Mean imputation, assembly and a tree learner. Scaling is left out: splits do not depend on it."""
    if kind not in KINDS:
        raise ValueError(f"unknown tree learner {kind!r}; choose from {sorted(KINDS)}")
    filled = [f"__filled_{f}" for f in features]
    return Pipeline(
        stages=[
            Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
            VectorAssembler(inputCols=filled, outputCol="__features"),
            _regressor(kind, label, seed, params),
        ]
    )


def fit_tree(train: DataFrame, features: Sequence[str], label: str, kind: str, seed: int = 0, **params) -> PipelineModel:
    spark = train.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return tree_pipeline(features, label, kind, seed, **params).fit(train)


def importances(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Gain-based importance per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return {f: float(v) for f, v in zip(features, values, strict=True)}


def predictions(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, "prediction")


def grid_cells(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def grid_search_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    kind: str,
    grid: Mapping[str, Sequence],
    fold: str,
    folds: int,
    seed: int = 0,
    parallelism: int = 4,
) -> tuple[list[dict], list[float], PipelineModel]:
    """Grid cells, their mean R2 over given folds, and the best cell refitted (first cell on ties).

    Fits run as Spark jobs, several at a time; the folds are a column of the table.
    """
    pipeline = tree_pipeline(features, label, kind, seed)
    learner = pipeline.getStages()[-1]
    cells = grid_cells(grid)
    maps = [{learner.getParam(name): value for name, value in cell.items()} for cell in cells]
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=label, metricName="r2"),
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
    )
    found: CrossValidatorModel = search.fit(train)
    return cells, list(found.avgMetrics), found.bestModel
