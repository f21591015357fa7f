"""Operators on the run table: one row per (model, seed) with metrics, parameters, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cv_r2", "test_r2", "test_mae", "test_rmse")
STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def run_summary(run_table: DataFrame, metrics: Sequence[str] = METRICS, model: str = "model") -> DataFrame:
    """Statistic x metric matrix per model, aggregated once and then laid out as rows."""
    present = [m for m in metrics if m in run_table.columns]
    agg = run_table.groupBy(model).agg(
        *[fn(m).alias(f"{m}__{s}") for s, fn in STATISTICS.items() for m in present]
    )
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("statistic"), *[F.col(f"{m}__{s}").alias(m) for m in present])
            for s in STATISTICS
        ]
    )
    return agg.select(model, F.inline(rows))


def mean_importance(run_table: DataFrame, importance: str = "importance", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean of each feature's importance over runs (a map column), per model."""
    return (
        run_table.select(*by, F.explode(importance).alias("feature", "value"))
        .groupBy(*by, "feature")
        .agg(F.avg("value").alias("mean_importance"))
    )


def closest_to_mean_run(run_table: DataFrame, metric: str = "test_r2", run: str = "seed", model: str = "model") -> DataFrame:
    """Per model the whole row of the most typical run: metric nearest its mean, first run on ties."""
    mean = F.avg(metric).over(Window.partitionBy(model))
    others = [c for c in run_table.columns if c != model]
    return (
        run_table.withColumn("__gap", F.abs(F.col(metric) - mean))
        .groupBy(model)
        .agg(F.min_by(F.struct(*others), F.struct("__gap", run)).alias("r"))
        .select(model, "r.*")
    )


def best_cv_run(run_table: DataFrame, metric: str = "cv_r2", run: str = "seed", model: str = "model") -> DataFrame:
    """Per model the row with the highest metric, first run on ties."""
    others = [c for c in run_table.columns if c != model]
    return (
        run_table.groupBy(model)
        .agg(F.min_by(F.struct(*others), F.struct(-F.col(metric), F.col(run))).alias("r"))
        .select(model, "r.*")
    )


def compare_models(run_table: DataFrame, model: str = "model") -> DataFrame:
    """Leaderboard: models by mean held-out R2. One row per model, so the ranking is tiny."""
    board = run_table.groupBy(model).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("test_r2").alias("mean_r2"),
        F.stddev_samp("test_r2").alias("std_r2"),
        F.avg("test_mae").alias("mean_mae"),
        F.avg("test_rmse").alias("mean_rmse"),
    )
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_r2"), model)).cast("bigint"))
