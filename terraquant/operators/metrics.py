"""Regression metrics, residual statistics and reproduction checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r2(observed: str, predicted: str) -> Column:
    """Coefficient of determination as one aggregate; a constant target scores 1 if hit exactly, else 0."""
    error = F.sum(F.pow(F.col(observed) - F.col(predicted), F.lit(2.0)))
    total = F.count(F.lit(1)) * F.var_pop(observed)
    return F.when(total > 0, 1.0 - error / F.nullif(total, F.lit(0.0))).when(error == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def regression_metrics(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, R2, MAE and RMSE per group, in one pass."""
    error = F.col(observed) - F.col(predicted)
    return df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        r2(observed, predicted).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def residual_statistics(df: DataFrame, residual: str, by: Sequence[str] = ()) -> DataFrame:
    r = F.col(residual)
    return df.groupBy(*by).agg(
        F.count(residual).alias("n"),
        F.avg(residual).alias("mean"),
        F.stddev_samp(residual).alias("std"),
        F.min(residual).alias("min"),
        F.max(residual).alias("max"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
    )


def reproduction_check(actual: DataFrame, stored: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """(keys, metric, stored, actual, diff, ok) for metrics recomputed against stored ones."""
    a = actual.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "actual")
    s = stored.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "stored")
    joined = s.join(a, [*keys, "metric"], "left")
    diff = F.abs(F.col("actual") - F.col("stored"))
    return joined.withColumn("diff", diff).withColumn("ok", F.coalesce(diff < tolerance, F.lit(False)))
