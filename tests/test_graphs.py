"""Separation, adjustment and boosted independence tests against plain restatements."""

import random
from itertools import chain, combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.operators import falsify, graph, growth
from terraquant.operators.splits import Growth

GRAPHS = {
    "collider": [("a", "c"), ("b", "c"), ("c", "d")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")],
    "m": [("u", "t"), ("u", "m"), ("v", "m"), ("v", "o"), ("t", "o")],
}
ALONE = {"collider": ["z"]}


def _random_graph(seed: int) -> list[tuple[str, str]]:
    rng, names = random.Random(seed), "abcdef"
    return [(x, y) for x, y in combinations(names, 2) if rng.random() < 0.4]


def _separated(edges, x, y, given) -> bool:
    """Moralised ancestral graph: no path from x to y outside the set."""
    keep, waiting = set(), [x, y, *given]
    while waiting:
        n = waiting.pop()
        if n not in keep:
            keep.add(n)
            waiting += [s for s, d in edges if d == n]
    own = [(s, d) for s, d in edges if s in keep and d in keep]
    near = {n: set() for n in keep}
    for s, d in own:
        near[s].add(d)
        near[d].add(s)
    for d in keep:
        for s, t in combinations([s for s, e in own if e == d], 2):
            near[s].add(t)
            near[t].add(s)
    seen, waiting = set(given), [x]
    while waiting:
        n = waiting.pop()
        if n not in seen:
            seen.add(n)
            waiting += near[n]
    return y not in seen or y in given


def _subsets(nodes):
    return chain.from_iterable(combinations(sorted(nodes), k) for k in range(len(nodes) + 1))


def test_separation_equals_the_moral_graph(spark):
    graphs = GRAPHS | {f"r{i}": _random_graph(i) for i in range(4)}
    asked, expected = [], {}
    for g, edges in graphs.items():
        nodes = {n for e in edges for n in e} | set(ALONE.get(g, ()))
        for x, y in combinations(sorted(nodes), 2):
            for given in _subsets(nodes - {x, y}):
                asked.append((g, x, y, list(given)))
                expected[g, x, y, given] = _separated(edges, x, y, given)
    queries = spark.createDataFrame(asked, "graph string, x string, y string, given array<string>")
    got = {(r["graph"], r["x"], r["y"], tuple(r["given"])): r["separated"] for r in graph.d_separated(graph.edge_table(spark, graphs), queries).collect()}
    assert got == expected
    assert 0 < sum(expected.values()) < len(expected)


def test_smallest_adjustment_sets(spark):
    graphs = GRAPHS | {f"r{i}": _random_graph(i) for i in range(3)}
    outcome = {"collider": "d", "diamond": "e", "m": "o"}
    for name in ("diamond", "m", "r0", "r1", "r2"):
        edges, out = graphs[name], outcome.get(name, "f")
        nodes = sorted({n for e in edges for n in e})
        treatments = spark.createDataFrame([(name, t) for t in nodes if t != out], "graph string, treatment string")
        got = {r["treatment"]: tuple(r["adjustment"]) for r in graph.minimal_adjustment_sets(graph.edge_table(spark, {name: edges}), treatments, out).collect()}
        for t in nodes:
            if t == out:
                continue
            below, waiting = set(), [t]
            while waiting:
                n = waiting.pop()
                waiting += [d for s, d in edges if s == n and d not in below]
                below |= {d for s, d in edges if s == n}
            cut = [e for e in edges if e[0] != t]
            fine = [s for s in _subsets(set(nodes) - below - {t, out}) if _separated(cut, t, out, s)]
            assert got.get(t) == (min(fine, key=lambda s: (len(s), s)) if fine else None)


def test_nodes_without_edges_stay(spark):
    alone = graph.isolated_nodes(spark, ALONE)
    edges = graph.edge_table(spark, {"collider": GRAPHS["collider"]})
    pairs = {(r["x"], r["y"]) for r in graph.implied_independencies(edges, alone).collect()}
    assert {("z", n) for n in "abcd"} <= pairs and ("a", "b") in pairs
    listed = falsify.permuted_conditions(spark, {"collider": GRAPHS["collider"]}, 3, "t", ALONE)
    assert "z" in {r["x"] for r in listed.collect()} | {r["y"] for r in listed.collect()}


@pytest.mark.parametrize("together", (1, 64))
def test_boosted_independence_equals_rows(spark, together):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 500).astype(float), rng.integers(0, 4, 500).astype(float)
    c = np.round(5 * (a * (b > 1) + rng.normal(0, 0.3, 500))) / 5  # few values, so every value has a bin
    d = c + rng.normal(0, 0.5, 500)
    data = {k: [None if i % 29 == n else float(x) for i, x in enumerate(v)] for n, (k, v) in enumerate({"a": a, "b": b, "c": c, "d": d}.items())}
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), "a double, b double, c double, d double").repartition(3)
    tests = [("a", "b", ()), ("a", "d", ("c",)), ("a", "d", ("b", "c")), ("a", "d", ())]
    got = falsify.independence_tests(df, tests, "gbt", rounds=3, rate=0.5, max_depth=2, bins=64, together=together)
    filled = {k: np.array([np.nan if x is None else x for x in v]) for k, v in data.items()}
    filled = {k: np.where(np.isnan(v), np.nanmean(v), v) for k, v in filled.items()}
    table = spark.createDataFrame([tuple(map(float, r)) for r in zip(*filled.values(), strict=True)], df.schema)
    for (x, y, given), row in zip(tests, got, strict=True):
        residuals = []
        for target in (x, y):
            if not given:
                residuals.append(filled[target] - filled[target].mean())
                continue
            # One regression by itself, on its given columns alone, scored row by row.
            own = growth.prepare(table, given, target, F.array(F.lit(0)), 1, bins=64)
            (model,) = growth.boost(own, [(0, -1, None)], Growth(max_depth=2), 3, 0.5)
            codes = np.array([np.searchsorted(c, filled[g], side="left") for g, c in zip(given, own.cuts, strict=True)])
            residuals.append(filled[target] - model.predict(own.placed(0, codes)))
        product = residuals[0] * residuals[1]
        assert np.isclose(row[3], np.sqrt(500) * product.mean() / product.std(), rtol=1e-6)
        assert row[5] == 500
    assert abs(got[3][3]) > 5
