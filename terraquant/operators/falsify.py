"""Residual independence tests and graph falsification by node permutation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.hashing import permutation_rows
from . import growth
from .graph import edge_table, implied_independencies, isolated_nodes, validate
from .moments import collect_conditioned
from .prep import impute_whole_table
from .splits import Growth

TESTS_PER_TILE = 128
ROWS_PER_TILE = 1 << 14
CONSTANT = "__constant"
TEST_SCHEMA = "x string, y string, given array<string>, statistic double, p_value double, n bigint"

Test = tuple[str, str, tuple[str, ...]]


def _linear_sums(df: DataFrame, variables: Sequence[str], tests: Sequence[Test]) -> dict[int, tuple[float, float, int]]:
    """Per test: sum and sum of squares of the residual products, and rows, from two passes in all.

    The first pass aggregates moments, from which every regression of a variable on
    a set follows. In the second each task turns its Arrow batches into residuals by
    one matrix product and keeps running sums, so all tests share the scan and a
    task emits one row per test.
    """
    # Every variable may have gaps, so a constant stands in for the label.
    groups, centres = collect_conditioned(df.withColumn(CONSTANT, F.lit(0.0)), variables, CONSTANT)
    m = groups[()]
    fill = m.feature_means()
    A = m.second_moments(fill)
    shift = np.array([centres.get(v, 0.0) for v in variables])
    place = {v: i for i, v in enumerate(variables)}
    regressions = sorted({(v, given) for x, y, given in tests for v in (x, y)})
    number = {t: i for i, t in enumerate(regressions)}
    weights = np.zeros((len(variables), len(regressions)))
    offsets = np.zeros(len(regressions))
    for (target, given), i in number.items():
        keep = [0, *[1 + place[g] for g in given], 1 + place[target]]
        beta, intercept = linalg.solve_ridge(A[np.ix_(keep, keep)])
        weights[place[target], i] += 1.0
        for b, g in zip(beta, given, strict=True):
            weights[place[g], i] -= b
        offsets[i] = intercept
    left = np.array([number[(x, given)] for x, _, given in tests])
    right = np.array([number[(y, given)] for _, y, given in tests])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, squares, rows = np.zeros(len(left)), np.zeros(len(left)), 0
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            x = np.where(np.isnan(x), fill, x)
            residual = x @ weights - offsets
            for start in range(0, len(left), TESTS_PER_TILE):
                tile = slice(start, start + TESTS_PER_TILE)
                product = residual[:, left[tile]] * residual[:, right[tile]]
                total[tile] += product.sum(axis=0)
                squares[tile] += (product * product).sum(axis=0)
            rows += len(batch)
        yield pd.DataFrame({"test": np.arange(len(left)), "total": total, "squares": squares, "n": rows})

    per_task = df.select(*variables).mapInPandas(sums, "test long, total double, squares double, n long")
    merged = per_task.groupBy("test").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    return {r["test"]: (r["total"], r["squares"], r["n"]) for r in merged.collect()}


def _boosted_sums(
    df: DataFrame, variables: Sequence[str], tests: Sequence[Test], rounds: int = 20, rate: float = 0.1, max_depth: int = 3, bins: int = 32, together: int = 128
) -> dict[int, tuple[float, float, int]]:
    """The same sums with boosted trees for every regression on the imputed table.

    The regressions grow side by side, `together` of them in the same scans; one more scan scores all of
    them from their node arrays and sums the residual products of all tests.
    """
    place = {v: i for i, v in enumerate(variables)}
    regressions = sorted({(v, given) for x, y, given in tests for v in (x, y)})
    number = {t: i for i, t in enumerate(regressions)}
    rows = growth.prepare(df, variables, variables, F.array(F.lit(0)), 1, bins)
    wanted = [(0, -1, tuple(place[g] for g in given), place[target]) for target, given in regressions if given]
    models: list[growth.Model] = []
    for at in range(0, len(wanted), together):
        models += growth.boost(rows, wanted[at : at + together], Growth(max_depth=max_depth), rounds, rate)
    fitted = iter(models)
    n = rows.sums[0, 0, 0]
    # Without a given set the regression is the mean.
    made = [next(fitted) if given else float(rows.sums[0, 0, 1 + place[target]] / n) for target, given in regressions]
    left = np.array([number[(x, given)] for x, _, given in tests])
    right = np.array([number[(y, given)] for _, y, given in tests])
    targets = [place[t] for t, _ in regressions]
    shared, layout = rows.spark.sparkContext.broadcast(made), rows.layout()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(m, None if isinstance(m, float) else m.paths(layout)) for m in shared.value]
        total, squares, count = np.zeros(len(left)), np.zeros(len(left)), 0
        for batch in batches:
            for n, codes, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, y = np.frombuffer(codes, layout.code_type).reshape(-1, n), np.frombuffer(y).reshape(-1, n)
                for start in range(0, n, ROWS_PER_TILE):
                    part = slice(start, start + ROWS_PER_TILE)
                    own = growth.both_ends(codes[:, part])
                    residual = np.stack([y[t, part] - (m if paths is None else m.told(own, paths)) for t, (m, paths) in zip(targets, made, strict=True)])
                    for i, (a, b) in enumerate(zip(left, right, strict=True)):
                        product = residual[a] * residual[b]
                        total[i] += product.sum()
                        squares[i] += product @ product
                count += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left))), pa.array(total), pa.array(squares), pa.array([count] * len(left))], ["test", "total", "squares", "n"])

    per_task = rows.blocks.select("n", "codes", "y").mapInArrow(sums, "test long, total double, squares double, n long")
    merged = per_task.groupBy("test").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    return {r["test"]: (r["total"], r["squares"], r["n"]) for r in merged.collect()}


def independence_tests(df: DataFrame, tests: Sequence[Test], learner: str = "linear", **params) -> list[tuple]:
    """Generalised covariance measure of each (x, y, given): (x, y, given, statistic, p, n).

    x and y are residualised on the given set; under independence the mean product
    of the residuals, scaled by its standard error, is standard normal.
    """
    if not tests:
        return []
    variables = sorted({v for x, y, given in tests for v in (x, y, *given)})
    rows = df.select(*[F.col(v).cast("double").alias(v) for v in variables])
    if learner == "linear":
        sums = _linear_sums(rows, variables, tests)
    elif learner == "gbt":
        sums = _boosted_sums(impute_whole_table(rows, variables), variables, tests, **params)
    else:
        raise ValueError(f"unknown learner {learner!r}")
    out = []
    for i, (x, y, given) in enumerate(tests):
        total, squares, n = sums[i]
        mean = total / n
        spread = (squares / n - mean * mean) ** 0.5
        t = float(n**0.5 * mean / spread) if spread > 0 else 0.0
        out.append((x, y, list(given), t, linalg.normal_two_sided(t), int(n)))
    return out


def test_table(df: DataFrame, tests: Sequence[Test], learner: str = "linear", **params) -> DataFrame:
    return df.sparkSession.createDataFrame(independence_tests(df, tests, learner, **params), TEST_SCHEMA)


def graph_conditions(
    spark: SparkSession, graphs: Mapping[str, Sequence[tuple[str, str]]], isolated: Mapping[str, Sequence[str]] | None = None
) -> dict[str, list[Test]]:
    """Distinct conditions of each graph, with x before y (a few dozen per graph at most)."""
    alone = isolated_nodes(spark, isolated) if isolated else None
    rows = implied_independencies(edge_table(spark, graphs), alone).collect()
    out: dict[str, set[Test]] = {g: set() for g in graphs}
    for r in rows:
        x, y = sorted((r["x"], r["y"]))
        out[r["graph"]].add((x, y, tuple(r["given"])))
    return {g: sorted(c) for g, c in out.items()}


def permuted_conditions(
    spark: SparkSession, graphs: Mapping[str, Sequence[tuple[str, str]]], permutations: int, tag: str, isolated: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """(graph, perm, x, y, given) of every graph (perm -1) and its node permutations.

    Renaming a graph's nodes renames its conditions, so the closure is worked out
    once per graph and the permutations are rows with a renaming map.
    """
    isolated = {g: own for g, own in (isolated or {}).items() if g in graphs}
    conditions = graph_conditions(spark, graphs, isolated)
    renamings = []
    for g, edges in graphs.items():
        nodes = sorted({n for e in edges for n in e} | set(isolated.get(g, ())))
        renamings.append((g, -1, dict(zip(nodes, nodes, strict=True))))
        for i, order in enumerate(permutation_rows(nodes, permutations, tag)):
            renamings.append((g, i, dict(zip(nodes, order, strict=True))))
    maps = spark.createDataFrame(renamings, "graph string, perm int, renamed map<string,string>")
    listed = spark.createDataFrame(
        [(g, x, y, list(given)) for g, c in conditions.items() for x, y, given in c],
        "graph string, x string, y string, given array<string>",
    )
    m = F.col("renamed")
    return (
        maps.join(listed, "graph")
        .select("graph", "perm", m[F.col("x")].alias("a"), m[F.col("y")].alias("b"), F.transform("given", lambda g: m[g]).alias("given"))
        .select("graph", "perm", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.array_sort("given").alias("given"))
        .distinct()
    )


def falsify_graphs(
    df: DataFrame,
    graphs: Mapping[str, Sequence[tuple[str, str]]],
    permutations: int = 500,
    significance: float = 0.05,
    learner: str = "linear",
    tag: str = "perm",
    tester: Callable[[DataFrame, Sequence[Test]], list[tuple]] | None = None,
    isolated: Mapping[str, Sequence[str]] | None = None,
    **params,
) -> DataFrame:
    """Violated independencies of graphs against node-permuted graphs, one row per graph.

    ``p_violations`` is the share of permuted graphs with no more violations (small =
    the graph explains the data better than chance), ``p_equivalent`` the share with
    the very same conditions. `isolated` names nodes without edges, by graph. Only the distinct conditions of all graphs, a bounded
    set, are tested on the data; verdicts are joined back to the permutations.
    """
    spark = df.sparkSession
    validate(graphs, df.columns)
    conditions = permuted_conditions(spark, graphs, permutations, tag, isolated)
    distinct = sorted((r["x"], r["y"], tuple(r["given"])) for r in conditions.select("x", "y", "given").distinct().collect())
    run = tester or (lambda d, t: independence_tests(d, t, learner, **params))
    verdicts = spark.createDataFrame(run(df, distinct), TEST_SCHEMA).select(
        "x", "y", "given", (F.col("p_value") < significance).alias("violated")
    )
    per_graph = (
        conditions.join(verdicts, ["x", "y", "given"])
        .groupBy("graph", "perm")
        .agg(
            F.count(F.lit(1)).alias("conditions"),
            F.count_if("violated").alias("violations"),
            F.array_sort(F.collect_set(F.struct("x", "y", "given"))).alias("set"),
        )
    )
    mine = per_graph.where("perm = -1").select(
        "graph", "conditions", F.col("violations").alias("own"), F.col("set").alias("own_set")
    )
    return (
        per_graph.where("perm >= 0")
        .select("graph", "violations", "set")
        .join(mine, "graph")
        .groupBy("graph", "conditions", F.col("own").alias("violations"))
        .agg(
            F.count(F.lit(1)).alias("permutations"),
            F.avg((F.col("violations") <= F.col("own")).cast("double")).alias("p_violations"),
            F.avg((F.col("set") == F.col("own_set")).cast("double")).alias("p_equivalent"),
            F.avg("violations").alias("mean_permuted_violations"),
        )
    )
