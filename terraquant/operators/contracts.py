"""Table, metadata and schema contracts, reported as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def check_required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column, present, filled): whether each required column exists and how many rows fill it."""
    present = set(df.columns)
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(c in present).alias("present"),
                    (F.count(c) if c in present else F.lit(0).cast("bigint")).alias("filled"),
                )
                for c in required
            ]
        ).alias("rows")
    )
    return counts.select(F.inline("rows"))


def add_missing_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Absent features become all-null doubles, left to imputation."""
    return df.withColumns({c: F.lit(None).cast("double") for c in required if c not in df.columns})


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(name, type) of numeric columns by schema, without the excluded ones."""
    return [
        (f.name, f.dataType.simpleString())
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def numeric_column_report(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, type, filled) for the numeric columns, counted in one pass."""
    columns = numeric_columns(df, exclude)
    return df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count(c).alias("filled"))
                for c, t in columns
            ]
        ).alias("rows")
    ).select(F.inline("rows"))


def check_row_contract(df: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(rule, expected, actual, ok): each rule is an expected text and an aggregate to compare."""
    return df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    F.lit(expected).alias("expected"),
                    actual.cast("string").alias("actual"),
                    actual.cast("string").eqNullSafe(F.lit(expected)).alias("ok"),
                )
                for name, (expected, actual) in rules.items()
            ]
        ).alias("rows")
    ).select(F.inline("rows"))


def ordered_labels(label: str, position: str) -> Column:
    """Labels in declared order as one text; for label sets of a fixed, small size."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(position).alias("p"), F.col(label).alias("l"))))
    return F.concat_ws("|", F.transform(pairs, lambda x: x["l"]))


def check_metadata_contract(spec: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """(item, expected, actual, ok) for dotted paths into a one-row metadata table."""
    return spec.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(item).alias("item"),
                        F.lit(str(value)).alias("expected"),
                        F.col(item).cast("string").alias("actual"),
                        F.col(item).cast("string").eqNullSafe(F.lit(value).cast("string")).alias("ok"),
                    )
                    for item, value in expected.items()
                ]
            )
        )
    )


def require_ok(report: DataFrame, what: str) -> DataFrame:
    """Fail with the broken rows of a contract report; hand the report back when all hold."""
    broken = report.where(~F.col("ok")).limit(20).collect()
    if broken:
        total = report.where(~F.col("ok")).count()
        raise ValueError(f"{what}: {total} broken rows, the first of them {[r.asDict() for r in broken]}")
    return report
