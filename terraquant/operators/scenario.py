"""Scenario tables: profiles, point totals, rankings and point checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flux_to_annual, litres_to_cubic_metres
from ..sources.study import DEFAULT_HLR_M3_M2_D, GWP_CH4, GWP_N2O, WATER_VOLUME_M3_PER_YEAR
from .contracts import require_columns
from .reshape import rank_desc, result_statistics


def score(model, df: DataFrame, features: Sequence[str] = (), prediction: str = "prediction") -> DataFrame:
    """Apply a fitted model to any table, batch or streaming.

    A linear model is a projection; a fitted Spark ML stage is transformed. Both
    impute and scale with their training statistics.
    """
    if isinstance(model, PipelineModel):
        return model.transform(require_columns(df, features))
    return require_columns(df, model.features).withColumn(prediction, model.predict())


def profiles(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean feature profile per label: an observation table condensed to a scenario table."""
    return df.groupBy(label).agg(*[F.avg(f).alias(f) for f in features])


def scenario_ranking(scenarios: DataFrame, model, label: str) -> tuple[DataFrame, DataFrame]:
    """Score and rank a scenario table; returns the ranking and its statistics."""
    ranked = rank_desc(score(model, scenarios).select(label, "prediction"), "prediction", label)
    return ranked, result_statistics(ranked, label, "prediction")


def point_totals(scenarios: DataFrame, log_ch4: Column, log_n2o: Column, hlr_litres: str, water_volume: float = WATER_VOLUME_M3_PER_YEAR) -> DataFrame:
    """Both targets' predictions as annual t CO2-eq and their sum."""
    out = scenarios.withColumns(
        {"log_ch4": log_ch4, "log_n2o": log_n2o, "hlr": litres_to_cubic_metres(hlr_litres, DEFAULT_HLR_M3_M2_D)}
    )
    out = out.withColumns(
        {
            "ch4": flux_to_annual(F.col("log_ch4"), F.col("hlr"), GWP_CH4, water_volume),
            "n2o": flux_to_annual(F.col("log_n2o"), F.col("hlr"), GWP_N2O, water_volume),
        }
    )
    return out.withColumn("total", F.col("ch4") + F.col("n2o"))


def point_prediction_check(predictions: DataFrame, label: str, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(label, expected, prediction, diff, ok) for every row of a table of stored (label, expected).

    A stored point without a prediction is reported as not ok.
    """
    rows = expected.select(label, "expected").join(predictions.select(label, "prediction"), label, "left")
    diff = F.abs(F.col("prediction") - F.col("expected"))
    return rows.withColumn("diff", diff).withColumn("ok", F.coalesce(diff < tolerance, F.lit(False)))


def heldout_residuals(scored: DataFrame, key: Sequence[str], observed: str, features: Sequence[str], is_test: str = "is_test") -> DataFrame:
    """Held-out rows with observation, prediction, residual and features; a map-only projection."""
    return scored.where(F.col(is_test)).select(
        *key,
        F.col(observed).alias("observed"),
        F.col("prediction").alias("predicted"),
        (F.col(observed) - F.col("prediction")).alias("residual"),
        *features,
    )
