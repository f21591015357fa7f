"""Profiles, summaries, pivots and top-k."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import student_quantile
from ..functions.order_stats import SKETCH_ACCURACY, exact_quantiles, value_order_rank
from ..session import materialise

# Degrees of freedom from which the t quantile is a series.
EXPANSION_FROM = 50


def _stack(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One aggregate pass, one output row per struct."""
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, missing, total) per column, in one pass."""
    return _stack(
        df,
        [
            F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))
            for c in columns
        ],
    )


def describe_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max) per column; std with n - 1."""
    return _stack(
        df,
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            )
            for c in columns
        ],
    )


def result_statistics(df: DataFrame, label: str, value: str) -> DataFrame:
    """Count, extremes with their labels (smallest label on ties), mean, std, median of a scored table.

    The median comes from the bracketed search, so no task has to hold the column.
    """
    (median,), _ = exact_quantiles(df, value, [0.5])
    return df.agg(
        F.count(value).alias("n"),
        F.max(value).alias("max_value"),
        F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("max_label"),
        F.min(value).alias("min_value"),
        F.min_by(label, F.struct(F.col(value), F.col(label))).alias("min_label"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.lit(median).cast("double").alias("median"),
    )


def long_format(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column)."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)


def normalise_share(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(out, F.try_divide(F.col(value), total))


def _t_critical(freedom: Column) -> Column:
    """97.5% quantile of Student's t for any degrees of freedom.

    Few degrees are looked up; from 50 on the expansion around the normal quantile is exact to
    about 1e-9.
    """
    known = F.create_map(*[F.lit(x) for n in range(1, EXPANSION_FROM) for x in (n, student_quantile(0.975, n))])
    z, n = 1.959963984540054, freedom.cast("double")
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = F.lit(z)
    for power, term in enumerate(terms, 1):
        series = series + term / F.pow(n, F.lit(power))
    return F.when(freedom < EXPANSION_FROM, F.try_element_at(known, freedom.cast("int"))).otherwise(series)


def t_confidence_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and 95% t interval of the scores of each group; one score has no interval."""
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.count(value).cast("int").alias("k"),
    )
    half = _t_critical(F.col("k") - 1) * F.col("sem")
    return stats.select(*by, "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def pivot_wide(df: DataFrame, index: Sequence[str], columns: str, values: str, labels: Sequence[str]) -> DataFrame:
    """One column per label; a repeated (index, label) pair is an error, not a silent pick."""
    once = F.when(F.count(values) > 1, F.raise_error(F.lit("duplicate entries for pivot index"))).otherwise(F.max(values))
    return df.groupBy(*index).pivot(columns, list(labels)).agg(once)


def interval_summary(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float] = (0.5, 0.025, 0.975)
) -> DataFrame:
    """Median and 95% interval of several columns per group, exact for groups of any number and size.

    A first scan sketches every column of every group and so brackets each wanted rank, with the
    sketch's guaranteed error; a second counts what lies below a bracket and how often each value
    inside it occurs. Only values inside brackets are shuffled and ordered, and nothing is written.
    Groups smaller than the sketch are their own bracket.
    """
    names = ("median", "lower", "upper")
    by, columns = list(by), list(columns)
    error = 2.0 / SKETCH_ACCURACY
    shares = [min(1.0, max(0.0, p + side)) for p in probs for side in (-error, error)]
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    keys, values = [f"__k{i}" for i in range(len(by))], [f"__v{i}" for i in range(len(columns))]
    told = rows.groupBy(*keys).agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.percentile_approx(v, shares, SKETCH_ACCURACY).alias(f"q{i}") for i, v in enumerate(values)],
        *[fn(v).alias(f"{e}{i}") for i, v in enumerate(values) for fn, e in ((F.min, "a"), (F.max, "b"))],
    )
    other = told.toDF(*[f"{c}_" for c in told.columns])
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.lit(True))
    met = rows.join(other, same)
    # One cell a column and probability: null stands for a value below the bracket.
    cells = []
    for i, v in enumerate(values):
        for j, p in enumerate(probs):
            # A rank moves by up to one row against its share, which a bracket's margin covers from this size on.
            small = F.col(f"n{i}_") < SKETCH_ACCURACY
            low = F.when(small, F.col(f"a{i}_")).otherwise(F.get(f"q{i}_", F.lit(2 * j)))
            high = F.when(small, F.col(f"b{i}_")).otherwise(F.get(f"q{i}_", F.lit(2 * j + 1)))
            at = (F.col(f"n{i}_") - 1) * F.lit(float(p))
            cells.append(F.when(F.col(v) <= high, F.struct(F.lit(i).alias("c"), F.lit(j).alias("p"), F.when(F.col(v) >= low, F.col(v)).alias("value"), at.alias("at"))))
    counted = met.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("x")).select(*keys, "x.*")
    counted = counted.groupBy(*keys, "c", "p", "at", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys, "c", "p").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(order)).where("value is not null")
    # The value at a 0-based rank is the first whose count reaches beyond it.
    side = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    found = upto.groupBy(*keys, "c", "p").agg(side(F.floor("at")).alias("low"), side(F.ceil("at")).alias("high"), F.max("at").alias("at"))
    found = found.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")))
    pick = lambda i, j: F.max(F.when((F.col("c") == i) & (F.col("p") == j), F.col("q")))
    wide = found.groupBy(*keys).agg(*[pick(i, j).alias(f"{c}_{n}") for i, c in enumerate(columns) for j, n in enumerate(names)])
    # Groups without any value keep their row.
    groups = df.select(*by).distinct()
    matched = reduce(operator.and_, [groups[k].eqNullSafe(wide[f"__k{i}"]) for i, k in enumerate(by)], F.lit(True))
    return groups.join(wide, matched, "left").select(*[groups[k] for k in by], *[wide[f"{c}_{n}"] for c in columns for n in names])


def probability_of(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def rank_desc(df: DataFrame, value: str, label: str, rank: str = "rank", descending: bool = True) -> DataFrame:
    """1..n by value, ties by label, ranked in parallel over range partitions at every size.

    The input is evaluated once, into the shared folder: range partitioning reads it twice.
    """
    order = [F.desc(value) if descending else F.asc(value), F.asc(label)]
    return value_order_rank(materialise(df, "ranking"), order, rank)


def head_tail_k(df: DataFrame, value: str, label: str, k: int = 10) -> DataFrame:
    """First and last k of a descending ranking (two bounded top-k heaps, no full sort)."""
    head = df.orderBy(F.desc(value), F.asc(label)).limit(k).withColumn("side", F.lit("head"))
    tail = df.orderBy(F.asc(value), F.desc(label)).limit(k).withColumn("side", F.lit("tail"))
    return head.unionByName(tail)


def top_k_features(df: DataFrame, importance: str, k: int, feature: str = "feature") -> DataFrame:
    return df.orderBy(F.desc(importance), F.asc(feature)).limit(k)


def growing_prefix(ranked: DataFrame, rank: str = "rank", feature: str = "feature") -> DataFrame:
    """Candidate set i = the first i features; for a ranking of features, which is short."""
    w = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("prefix", F.collect_list(feature).over(w))


def assumption_table(df: DataFrame, items: Sequence[tuple[str, Column]]) -> DataFrame:
    """(item, value) record of constants and facts about the data, all as text."""
    return _stack(df, [F.struct(F.lit(k).alias("item"), v.cast("string").alias("value")) for k, v in items])
