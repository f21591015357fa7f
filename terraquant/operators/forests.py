"""Tree learners over seeds, folds and grids, on the replicated growth of `operators.growth`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import Drawn, drawn_text, draws_below
from . import growth
from .growth import Model, Rows, Spec
from .splits import Growth


def replicated_rows(
    df: DataFrame, features: Sequence[str], label: str, key: str, seeds: int, folds: int = 5, draws: int = 0, tag: str = "tree", bins: int = 128, test_fraction: float = 0.3,
) -> Rows:
    """Binned rows with the parts of all seeds, and `draws` keyed draws a row for bootstraps and subsamples."""
    # The part of a row in every seed, of the linear runs too: test below the fraction, else a fold.
    parts = Drawn(drawn_text(key, seeds), seeds, draws_below(test_fraction))
    return growth.prepare(df, features, label, parts, folds, bins, Drawn(drawn_text(key, draws, tag), draws) if draws else None)


def grid_models(rows: Rows, seeds: Sequence[int], grid: Mapping[str, Sequence], base: Growth = Growth(), trees: int = 1, held: Sequence[int] | None = None) -> list[Model]:
    """A model for every seed, fold left out (-1: none) and grid cell.

    Grid keys are fields of `Growth`, and `trees`. Cells that differ in `max_depth` or `trees` alone
    share their trees: a shallower tree is the top of a deeper one, a smaller forest the first of a larger.
    """
    cells = growth.grid_cells(grid)
    held = list(range(-1, rows.folds)) if held is None else list(held)
    shared: dict[tuple, list[int]] = {}
    for i, c in enumerate(cells):
        shared.setdefault(tuple((k, v) for k, v in c.items() if k not in ("max_depth", "trees")), []).append(i)
    specs: list[Spec] = []
    order: dict[tuple, list[int]] = {}
    for own, members in shared.items():
        deepest = max(cells[i].get("max_depth", base.max_depth) for i in members)
        most = max(cells[i].get("trees", trees) for i in members)
        grown = replace(base, **dict(own), max_depth=deepest)
        for seed in seeds:
            for h in held:
                order[own, seed, h] = list(range(len(specs), len(specs) + most))
                specs += [Spec(seed, h, k, grown) for k in range(most)]
    made = growth.grow(rows, specs)
    out = []
    for own, members in shared.items():
        for seed in seeds:
            for h in held:
                for i in members:
                    own_trees = [made[k] for k in order[own, seed, h][: cells[i].get("trees", trees)]]
                    out.append(Model(seed, h, i, own_trees, depth=cells[i].get("max_depth", base.max_depth)))
    return out


def scored_cells(rows: Rows, models: Sequence[Model]) -> DataFrame:
    """(seed, cell, held, r2, mae, rmse) of every model, on the fold it left out or on the test rows."""
    names = rows.spark.createDataFrame([(i, m.rep, m.cell, m.held) for i, m in enumerate(models)], "model long, seed int, cell int, held int")
    return growth.evaluate(rows, models).join(names, "model").drop("model", "n")


def run_table(rows: Rows, models: Sequence[Model], learner: str, cells: Sequence[Mapping]) -> DataFrame:
    """Per seed the cell with the best mean fold R2 (nine digits; the first on ties) and its test metrics after the refit."""
    told = scored_cells(rows, models)
    mean = told.where("held >= 0").groupBy("seed", "cell").agg(F.round(F.avg("r2"), 9).alias("cv_r2"))
    best = mean.groupBy("seed").agg(F.min_by(F.struct("cell", "cv_r2"), F.struct(-F.col("cv_r2"), F.col("cell"))).alias("b")).select("seed", "b.*")
    params = F.array(*[F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.lit(str(v)))]) for c in cells])
    test = told.where("held = -1").select("seed", "cell", F.col("r2").alias("test_r2"), F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"))
    return best.join(test, ["seed", "cell"]).select(
        F.lit(learner).alias("model"), "seed", "cv_r2", "test_r2", "test_mae", "test_rmse", F.get(params, F.col("cell")).alias("params")
    )


def cell_table(rows: Rows, models: Sequence[Model]) -> DataFrame:
    """(cell, cv_r2, chosen, test_r2): mean fold R2 over all seeds, how many seeds choose the cell, and their mean test R2 (0 without any)."""
    told = scored_cells(rows, models)
    test = told.where("held = -1").select("seed", "cell", "r2")
    mean = told.where("held >= 0").groupBy("seed", "cell").agg(F.round(F.avg("r2"), 9).alias("cv_r2")).join(test, ["seed", "cell"])
    first = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("cv_r2"), "cell")) == 1
    return mean.withColumn("first", first).groupBy("cell").agg(
        F.avg("cv_r2").alias("cv_r2"),
        F.count_if("first").alias("chosen"),
        F.coalesce(F.avg(F.when(F.col("first"), F.col("r2"))), F.lit(0.0)).alias("test_r2"),
    )


def prefix_scores(rows: Rows, grown: Growth, rounds: int, rate: float) -> DataFrame:
    """(rank, feature, fold, r2) of a boosted learner on every prefix of the rows' features; one growth for all prefixes and folds."""
    models = [(0, h, tuple(range(k))) for k in range(1, len(rows.features) + 1) for h in range(rows.folds)]
    made = growth.boost(rows, models, grown, rounds, rate)
    names = [(i, len(own), rows.features[len(own) - 1], h) for i, (_, h, own) in enumerate(models)]
    named = rows.spark.createDataFrame(names, "model long, rank long, feature string, fold int")
    return growth.evaluate(rows, made).join(named, "model").select("rank", "feature", "fold", "r2")


def gain_shares(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(rep, held, cell, feature, share): the share of a model's gain that each feature has, 0 for those it does not use."""
    by = ["rep", "held", "cell"]
    known = growth.split_counts(nodes, by)
    every = nodes.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, features))).alias("feature"))
    told = every.join(known, [*by, "feature"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    whole = F.sum("gain").over(Window.partitionBy(*by))
    return told.select(*by, "feature", F.when(whole > 0, F.col("gain") / whole).otherwise(F.lit(0.0)).alias("share"))
