"""Plan fragments shared by the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, linear, split
from ..sources.tables import FEATURES, KEY, LABEL, TIEBREAK, observations

SCENARIOS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# Stand-in graph on the observation view: every feature acts on the target.
OBS_GRAPH = [("x_qty", "y"), ("x_price", "y"), ("x_disc", "y")]


def clipped(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Observations inside the 1-99% target quantiles; the bounds read only the target."""
    b = clean.quantile_bounds(observations(spark, sf_dir, [LABEL]), LABEL)
    return clean.clip_between(observations(spark, sf_dir, [*columns, LABEL]), LABEL, b.low, b.high)


def split_rows(spark: SparkSession, sf_dir: str, extra: Sequence[str] = (), features: Sequence[str] = FEATURES) -> DataFrame:
    """Clipped observations with the seed-0 threshold split."""
    return split.split_threshold(clipped(spark, sf_dir, [KEY, TIEBREAK, *extra, *features]), 0, KEY)


def fitted(spark: SparkSession, sf_dir: str, extra: Sequence[str] = (), features: Sequence[str] = FEATURES,
           learner: str = "ols", alpha: float = 0.0) -> tuple[DataFrame, linear.LinearModel]:
    rows = split_rows(spark, sf_dir, extra, features)
    return rows, linear.fit(rows.where(~F.col("is_test")), features, LABEL, learner, alpha)


def scored(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> tuple[DataFrame, linear.LinearModel]:
    rows, model = fitted(spark, sf_dir, extra)
    return rows.withColumn("prediction", model.predict()), model
