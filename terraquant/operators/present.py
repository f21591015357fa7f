"""The tables behind the study's figures; drawing them is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flagged
from ..session import materialise
from ..sources.study import PROVINCES
from .clean import name_normalise, padded_axis_range, scale_for_colour
from .reshape import rank_desc


def map_table(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, value, low, high): English labels with the colour range of the whole map."""
    named = name_normalise(df, label, PROVINCES, out="__english").select(F.col("__english").alias("label"), F.col(value).alias("value"))
    named = materialise(named, "map-values")
    span = named.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")).alias("s")).scalar()
    return named.select("label", "value", span["low"].alias("low"), span["high"].alias("high"))


def ranking_bar_table(df: DataFrame, label: str, value: str) -> DataFrame:
    """Bars from shortest to longest with their colour share."""
    rows = materialise(df.select(F.col(label).alias("label"), F.col(value).alias("value")), "bar-values")
    return rank_desc(scale_for_colour(rows, "value"), "value", "label", "position", descending=False)


def driver_bar_table(dispersion: DataFrame, focus: Sequence[str], value: str = "shap_std") -> DataFrame:
    """Features by attribution spread, focus features flagged."""
    return rank_desc(dispersion.withColumn("focus", flagged("feature", focus)), value, "feature", "position", descending=False)


def selection_curve_table(curve: DataFrame, n: int) -> DataFrame:
    return curve.withColumn("selected", F.col("rank") <= n)


def prediction_scatter_table(scored: DataFrame, ids: Sequence[str], observed: str, is_test: str = "is_test") -> DataFrame:
    """Observed against predicted with the split and the common axis range."""
    axis = padded_axis_range(scored, [observed, "prediction"]).select(F.struct("axis_min", "axis_max").alias("a")).scalar()
    return scored.select(
        *ids,
        F.when(F.col(is_test), "test").otherwise("train").alias("part"),
        F.col(observed).alias("observed"),
        F.col("prediction").alias("predicted"),
        axis["axis_min"].alias("axis_min"),
        axis["axis_max"].alias("axis_max"),
    )
