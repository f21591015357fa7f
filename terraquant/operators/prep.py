"""Mean imputation and min-max scaling fitted on the training part of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def fit_preprocessing(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), train: Column | None = None) -> DataFrame:
    """One row per group: mean, minimum and maximum of each feature over its training rows.

    Mean imputation moves neither minimum nor maximum, so both steps are fitted in
    one pass over the raw values.
    """
    rows = df if train is None else df.where(train)
    return rows.groupBy(*by).agg(
        *[
            F.struct(F.avg(f).alias("mean"), F.min(f).alias("low"), F.max(f).alias("high")).alias(f"__{f}")
            for f in features
        ]
    )


def apply_preprocessing(
    df: DataFrame, stats: DataFrame, features: Sequence[str], by: Sequence[str] = (), impute: bool = True, scale: bool = True,
) -> DataFrame:
    """Impute and scale features in place. Values outside the training range are not clamped.

    Without groups the statistics are scalar subqueries. With groups they are written
    and joined by equality.
    """
    if by:
        # Written, so that the optimiser knows its size when it chooses the join.
        joined = df.join(materialise(stats, "group-statistics"), list(by))
        stat = lambda f: F.col(f"__{f}")
    else:
        joined = df
        packed = stats.select(F.struct(*[F.col(f"__{f}") for f in features]).alias("s"))
        stat = lambda f: packed.select(F.col(f"s.__{f}")).scalar()

    def encoded(f: str) -> Column:
        s = stat(f)
        value = F.coalesce(F.col(f), s["mean"]) if impute else F.col(f)
        if not scale:
            return value
        span = s["high"] - s["low"]
        return F.when(span == 0, F.lit(0.0)).otherwise((value - s["low"]) / span)

    out = [encoded(c).alias(c) if c in features else F.col(c) for c in df.columns]
    return joined.select(*out)


def impute_mean(df: DataFrame, features: Sequence[str], train: Column | None = None) -> DataFrame:
    return apply_preprocessing(df, fit_preprocessing(df, features, train=train), features, scale=False)


def minmax_scale(df: DataFrame, features: Sequence[str], train: Column | None = None) -> DataFrame:
    """Scale already imputed features; a constant column becomes 0."""
    return apply_preprocessing(df, fit_preprocessing(df, features, train=train), features, impute=False)


def impute_by_seed(df: DataFrame, features: Sequence[str], seeds: int, scale: bool = True, seed: str = "seed", is_test: str = "is_test") -> DataFrame:
    """Per-seed preprocessing of a table replicated over seeds."""
    stats = fit_preprocessing(df, features, by=[seed], train=~F.col(is_test))
    return apply_preprocessing(df, stats, features, by=[seed], scale=scale)


def impute_whole_table(df: DataFrame, features: Sequence[str], scale: bool = False) -> DataFrame:
    """The effect-estimation variant: fitted on every row, no split."""
    return apply_preprocessing(df, fit_preprocessing(df, features), features, scale=scale)
