"""Seeded train/test splits and folds that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import below, seed_hex, tagged_bits, with_seed_draws
from ..functions.order_stats import hash_order_cutoffs, order_struct


def split_exact(
    df: DataFrame, seed: int, key: str, tiebreak: Sequence[str] = (), test_fraction: float = 0.3, out: str = "is_test"
) -> DataFrame:
    """Exactly ceil(fraction * n) test rows: the first rows of the seeded hash order.

    Only the boundary row of the order is looked up; every row is then labelled by
    one comparison where it lies.
    """
    size = lambda n: [F.ceil(n * F.lit(test_fraction) - F.lit(1e-9)).cast("bigint")]
    cut = hash_order_cutoffs(df, str(seed), key, tiebreak, size).select(F.element_at("cuts", 1)).scalar()
    return df.withColumn(out, order_struct(str(seed), key, tiebreak) <= cut)


def split_threshold(df: DataFrame, seed: int, key: str, test_fraction: float = 0.3, out: str = "is_test") -> DataFrame:
    """Each row is a test row with the given probability, decided from its own key."""
    return df.withColumn(out, below(seed_hex(seed, key), test_fraction))


def replicate_splits(df: DataFrame, seeds: int, key: str, test_fraction: float = 0.3, out: str = "is_test") -> DataFrame:
    """All rows under every seed, the seed a column; agrees with ``split_threshold`` seed by seed."""
    drawn = with_seed_draws(df, seeds, key)
    return drawn.withColumn(out, below(F.col("draw"), test_fraction)).drop("draw")


def kfold_shuffled(df: DataFrame, folds: int, seed: int, key: str, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(tagged_bits(f"fold{seed}", key), F.lit(folds)).cast("int"))


def kfold_contiguous(
    df: DataFrame, folds: int, seed: int, key: str, tiebreak: Sequence[str] = (), out: str = "fold"
) -> DataFrame:
    """Folds of equal size (the first n mod k one larger), consecutive in the seeded hash order."""
    last_rows = lambda n: [
        (F.floor(n / folds) * i + F.least(F.pmod(n, F.lit(folds)), F.lit(i))).cast("bigint") for i in range(1, folds)
    ]
    cuts = hash_order_cutoffs(df, f"fold{seed}", key, tiebreak, last_rows).select("cuts").scalar()
    here = order_struct(f"fold{seed}", key, tiebreak)
    passed: Column = F.lit(0)
    for i in range(folds - 1):
        passed = passed + F.coalesce((here > F.get(cuts, F.lit(i))).cast("int"), F.lit(0))
    return df.withColumn(out, passed.cast("int"))
