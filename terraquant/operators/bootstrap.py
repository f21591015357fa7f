"""Bootstrap propagation of held-out residuals into scenario totals.

Draws are keyed hashes, so a simulation is reproducible on any cluster layout. A
draw names a position in the held-out pool; the pool is indexed slice by slice and
met by an equi-join with the draws as the small side, so the pool never leaves its
partitions for the lookup.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flux_to_annual
from ..functions.order_stats import hash_order_index
from ..session import materialise
from ..sources.study import GWP_CH4, GWP_N2O, WATER_VOLUME_M3_PER_YEAR
from .reshape import interval_summary, pivot_wide, probability_of

BLOCK = 1000
TOTALS = ("ch4", "n2o", "total")
ANALYSES = ("paired", "independent")


def expand_draws(scenarios: DataFrame, draws: int, simulation: str = "simulation") -> DataFrame:
    """Every scenario under draws 1..n, generated in blocks so that tasks share the work."""
    blocks = -(-draws // BLOCK)
    first = scenarios.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    if blocks > 1:
        cores = scenarios.sparkSession.sparkContext.defaultParallelism
        first = first.repartition(min(blocks, 4 * cores), "__block")
    start = F.col("__block") * BLOCK + 1
    stop = F.least(start + BLOCK - 1, F.lit(draws))
    return first.select("*", F.explode(F.sequence(start, stop)).alias(simulation)).drop("__block")


@dataclass(frozen=True)
class Pool:
    """Held-out residuals by position, and their number as a scalar subquery."""

    rows: DataFrame
    size: Column


def residual_pool(heldout: DataFrame, residual: str, key: str, tiebreak: Sequence[str], target: str) -> Pool:
    """(idx, residual) over every held-out row, indexed in a hash order of the row key."""
    rows = heldout.where(F.col(residual).isNotNull()).select(key, *tiebreak, residual)
    indexed = hash_order_index(rows, f"pool_{target}", key, tiebreak).select("idx", F.col(residual).alias("residual"))
    return Pool(indexed, rows.agg(F.count(F.lit(1)).alias("n")).scalar())


def draw_index(target: str, seed: int, parts: Sequence[Column], size: Column) -> Column:
    """Sixty hash bits of (seed, target, parts) reduced to a pool position; null parts are left out."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(target), *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), size)


def simulate(
    scenarios: DataFrame,
    pools: dict[str, Pool],
    draws: int,
    seed: int,
    analyses: Sequence[str] = ANALYSES,
    label: str = "scenario",
    water_volume: float = WATER_VOLUME_M3_PER_YEAR,
) -> DataFrame:
    """Scenario totals under residual draws, all analyses in one plan.

    ``scenarios`` carries ``log_ch4``, ``log_n2o`` and ``hlr`` per label. In the
    ``paired`` analysis a draw has one residual per target, shared by all scenarios;
    in the ``independent`` analysis one per scenario as well. The two targets are
    always drawn independently. Each pool is read once for all analyses.
    """
    rows = scenarios.select("*", F.explode(F.array(*[F.lit(a) for a in analyses])).alias("analysis"))
    rows = expand_draws(rows, draws)
    own = F.when(F.col("analysis") == "independent", F.col(label))
    for target in ("ch4", "n2o"):
        named = rows.withColumn("__idx", draw_index(target, seed, [F.col("simulation"), own], pools[target].size))
        pool = pools[target].rows.select(F.col("idx").alias("__idx"), F.col("residual").alias(f"res_{target}"))
        rows = pool.join(named, "__idx").drop("__idx")
    for target, gwp in (("ch4", GWP_CH4), ("n2o", GWP_N2O)):
        log_flux = F.col(f"log_{target}") + F.col(f"res_{target}")
        rows = rows.withColumn(target, flux_to_annual(log_flux, F.col("hlr"), gwp, water_volume))
    return rows.withColumn("total", F.col("ch4") + F.col("n2o")).select(
        "analysis", "simulation", label, "res_ch4", "res_n2o", "ch4", "n2o", "total"
    )


def uncertainty_summary(simulations: DataFrame, draws: int, label: str = "scenario") -> DataFrame:
    return interval_summary(simulations, ["analysis", label], TOTALS)


def scenario_contrast(simulations: DataFrame, a: str, b: str, label: str = "scenario", by: Sequence[str] = ("analysis",)) -> DataFrame:
    """Per draw: totals of two scenarios, their difference, and the difference relative to the second."""
    chosen = simulations.where(F.col(label).isin(a, b)).select(*by, "simulation", label, "total")
    wide = pivot_wide(chosen, [*by, "simulation"], label, "total", [a, b])
    return wide.select(
        *by,
        "simulation",
        F.col(a).alias("a"),
        F.col(b).alias("b"),
        (F.col(a) - F.col(b)).alias("difference"),
        ((F.col(a) - F.col(b)) / F.col(b)).alias("relative"),
    )


def contrast_summary(contrast: DataFrame, draws: int, by: Sequence[str] = ("analysis",)) -> DataFrame:
    """Probability that the first scenario exceeds the second, with medians and 95% intervals."""
    contrast = materialise(contrast, "contrast")
    chance = contrast.groupBy(*by).agg(probability_of(F.col("difference") > 0).alias("p_higher"))
    return chance.join(interval_summary(contrast, by, ("difference", "relative")), list(by))
