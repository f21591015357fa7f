"""Row filters and value repair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import finite, rename_by, to_number
from ..functions.order_stats import exact_quantiles


@dataclass(frozen=True)
class Bounds:
    low: float
    high: float
    rows: int


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def quantile_bounds(
    df: DataFrame, target: str, low: float = 0.01, high: float = 0.99, approx: bool = False
) -> Bounds:
    """Lower and upper quantile of the target over the whole table, as numbers.

    Exact and linearly interpolated; ``approx=True`` takes one bounded sketch instead.
    """
    if approx:
        row = df.agg(
            F.percentile_approx(target, [low, high], 100_000).alias("q"), F.count(target).alias("n")
        ).first()
        return Bounds(row["q"][0], row["q"][1], row["n"])
    (q_low, q_high), rows = exact_quantiles(df, target, [low, high])
    return Bounds(q_low, q_high, rows)


def clip_between(df: DataFrame, target: str, low: float, high: float) -> DataFrame:
    """Keep rows inside stored bounds, both ends included; rows without a target go."""
    return df.where(F.col(target).between(low, high))


def clip_by_quantile(df: DataFrame, target: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Keep rows between two quantiles of the target.

    The bounds are literals in the returned plan, so the filter joins the other
    predicates of the scan.
    """
    b = quantile_bounds(df, target, low, high)
    return clip_between(df, target, b.low, b.high)


def clip_report(df: DataFrame, target: str, bounds: Bounds) -> DataFrame:
    kept = F.count_if(F.col(target).between(bounds.low, bounds.high))
    return df.agg(
        F.lit(bounds.low).alias("low"), F.lit(bounds.high).alias("high"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("removed")
    )


def clip_by_spec(df: DataFrame, target: str, spec: DataFrame, low: str, high: str) -> DataFrame:
    """Keep rows between bounds stored in a one-row spec table, read as scalar subqueries."""
    return df.where(
        (F.col(target) >= spec.select(low).scalar()) & (F.col(target) <= spec.select(high).scalar())
    )


def label_filter_ordered(df: DataFrame, label: str, labels: Sequence[str], position: str = "pos") -> DataFrame:
    """Rows whose label is listed, with the label's place in the list (order by it to present)."""
    listed = F.array(*[F.lit(x) for x in labels])
    return df.where(F.col(label).isin(list(labels))).withColumn(
        position, (F.array_position(listed, F.col(label)) - 1).cast("int")
    )


def name_normalise(df: DataFrame, label: str, provinces: Sequence[tuple[str, str, str]], out: str = "english") -> DataFrame:
    """Short or official name to English label through two fixed lookups."""
    full = rename_by(label, [(short, official) for short, official, _ in provinces])
    return df.withColumn("full_name", full).withColumn(out, rename_by("full_name", [(o, e) for _, o, e in provinces]))


def scale_for_colour(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Position of each value between the table's minimum and maximum.

    The range is a one-row aggregate read as a scalar subquery, so rows never move.
    """
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("r"))
    low = span.select("r.lo").scalar()
    high = span.select("r.hi").scalar()
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)))


def padded_axis_range(df: DataFrame, columns: Sequence[str], pad: float = 0.05) -> DataFrame:
    """Common axis range of several columns, widened by a share of its length on both sides."""
    low: Column = F.least(*[F.min(c) for c in columns])
    high: Column = F.greatest(*[F.max(c) for c in columns])
    return df.agg(low.alias("lo"), high.alias("hi")).select(
        (F.col("lo") - pad * (F.col("hi") - F.col("lo"))).alias("axis_min"),
        (F.col("hi") + pad * (F.col("hi") - F.col("lo"))).alias("axis_max"),
    )
