"""Replicated growth, boosting and exact attribution against row-level and brute-force versions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.operators import attribution, forests, growth
from terraquant.operators.splits import Growth, choose, unit

FEATURES = ["u", "v", "w"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        u, v, w = float(rng.integers(0, 8)), float(rng.integers(0, 5)), float(rng.integers(0, 3))
        y = 2.0 * (u > 3) + v * (w > 1) + 0.3 * u + float(rng.normal(0, 0.2))
        rows.append((f"k{i}", None if i % 11 == 0 else u, v, None if i % 17 == 0 else w, y))
    return spark.createDataFrame(rows, "k string, u double, v double, w double, y double").repartition(3).cache()


@pytest.fixture(scope="module")
def rows(table):
    return forests.replicated_rows(table, FEATURES, "y", "k", seeds=3, folds=4, draws=6)


def _collected(rows):
    got = rows.table.collect()
    return (
        np.array([r["parts"] for r in got]), np.array([r["codes"] for r in got]).T, np.array([r["y"][0] for r in got]), np.array([r["draws"] for r in got])
    )


def _plain_tree(rows, rep, train, weight, depth, min_leaf):
    """Recursive exact search; returns a function of a row's placed codes."""
    _, codes, y, _ = _collected(rows)
    codes = rows.placed(rep, codes)

    def node(own, level):
        w = weight[own]
        mean = (w * y[own]).sum() / w.sum()
        best = (1e-12, None)
        if level < depth:
            for f in range(len(codes)):
                for cut in np.unique(codes[f, own])[:-1]:
                    left, right = own[codes[f, own] <= cut], own[codes[f, own] > cut]
                    wl, wr = weight[left].sum(), weight[right].sum()
                    if min(wl, wr) < min_leaf or min(wl, wr) <= 0:
                        continue
                    sl, sr = (weight[left] * y[left]).sum(), (weight[right] * y[right]).sum()
                    gain = sl**2 / wl + sr**2 / wr - (sl + sr) ** 2 / (wl + wr)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left, right))
        if best[1] is None:
            return lambda row: mean
        f, cut, left, right = best[1]
        a, b = node(left, level + 1), node(right, level + 1)
        return lambda row: a(row) if row[f] <= cut else b(row)

    return codes, node(np.flatnonzero(train & (weight > 0)), 0)


@pytest.mark.parametrize(("held", "bootstrap", "min_leaf"), ((-1, False, 1), (2, False, 15), (1, True, 3)))
def test_trees_of_all_seeds_equal_a_recursive_search(rows, held, bootstrap, min_leaf):
    grown = Growth(max_depth=3, min_leaf=min_leaf, bootstrap=bootstrap)
    trees = growth.grow(rows, [growth.Spec(rep, held, rep, grown) for rep in range(3)])
    parts, codes, y, draws = _collected(rows)
    for rep, tree in enumerate(trees):
        train = (parts[:, rep] >= 0) & (parts[:, rep] != held)
        weight = np.searchsorted(growth.POISSON, draws[:, rep] / 2.0**32, side="right").astype(float) if bootstrap else np.ones(len(y))
        placed, plain = _plain_tree(rows, rep, train, weight, 3, min_leaf)
        got = growth.Model(rep, held, 0, [tree]).predict(placed)
        assert np.allclose(got, [plain(c) for c in placed.T])


def test_grid_shares_trees_and_evaluates_every_fold(rows):
    grid = {"max_depth": [1, 3], "min_leaf": [1, 40], "trees": [1, 2]}
    models = forests.grid_models(rows, range(3), grid, Growth(bootstrap=True))
    assert len(models) == 3 * 5 * 8
    told = {(r["seed"], r["cell"], r["held"]): r for r in forests.scored_cells(rows, models).collect()}
    assert len(told) == len(models)
    parts, codes, y, _ = _collected(rows)
    for m in models[::7]:
        own = parts[:, m.rep] == m.held
        error = y[own] - m.predict(rows.placed(m.rep, codes)[:, own])
        r = told[m.rep, m.cell, m.held]
        assert np.isclose(r["mae"], np.abs(error).mean()) and np.isclose(r["r2"], 1 - (error**2).sum() / ((y[own] - y[own].mean()) ** 2).sum())
    table = forests.run_table(rows, models, "t", growth.grid_cells(grid)).collect()
    assert sorted(r["seed"] for r in table) == [0, 1, 2] and all(r["cv_r2"] > 0.5 for r in table)


def test_boosting_over_written_margins_equals_growth_on_residuals(rows, monkeypatch):
    whole = growth.boost(rows, [(0, -1, None), (1, 2, (0, 1))], Growth(max_depth=2, l2=1.0), 5, 0.5)
    monkeypatch.setattr(growth, "REFRESH", 2)
    again = growth.boost(rows, [(0, -1, None), (1, 2, (0, 1))], Growth(max_depth=2, l2=1.0), 5, 0.5)
    _, codes, _, _ = _collected(rows)
    for a, b in zip(whole, again, strict=True):
        assert np.allclose(a.predict(rows.placed(a.rep, codes)), b.predict(rows.placed(b.rep, codes)))
    assert all(t.feature[i] != 2 for t in whole[1].trees for i in range(len(t.feature)))
    assert len({tuple(t.value()) for t in whole[0].trees}) == 5


def test_best_first_takes_the_largest_gains(rows):
    (deep,) = growth.grow(rows, [growth.Spec(0, -1, 0, Growth(max_depth=6))])
    (few,) = growth.grow(rows, [growth.Spec(0, -1, 0, Growth(max_depth=6, max_leaves=6))])
    gain = {p: g for p, g, f in zip(deep.path, deep.gain, deep.feature, strict=True) if f >= 0}
    taken, waiting = set(), {1}
    while len(taken) < 5:
        best = max((p for p in waiting if p in gain), key=lambda p: gain[p])
        taken.add(best)
        waiting = waiting - {best} | {2 * best, 2 * best + 1}
    assert {p for p, f in zip(few.path, few.feature, strict=True) if f >= 0} == taken
    assert sum(f < 0 for f in few.feature) == 6


def test_symmetric_levels_and_drawn_thresholds(rows):
    (even,) = growth.grow(rows, [growth.Spec(0, -1, 0, Growth(max_depth=3, symmetric=True))])
    for level in range(3):
        cuts = {(even.feature[i], even.slot[i]) for i in range(len(even.feature)) if even.depth(i) == level and even.feature[i] >= 0}
        assert len(cuts) == 1
    trees = growth.grow(rows, [growth.Spec(0, -1, k, Growth(max_depth=2, drawn=True)) for k in range(6)])
    assert len({t.threshold[0] for t in trees}) == 6
    f = trees[0].feature[0]
    low, high = rows.slot_values(0, f)[[0, -1]]
    assert trees[0].threshold[0] == low + unit("cut", 0, -1, 0, 1, f) * (high - low)


def test_nothing_to_split(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0), ("c", None, 4.0)], "k string, u double, y double")
    own = growth.prepare(df, ["u"], "y", F.array(F.lit(0)), 1)
    (tree,) = growth.grow(own, [growth.Spec(0)])
    assert tree.feature == [-1] and tree.value().tolist() == [3.0]
    with pytest.raises(ValueError):
        growth.prepare(df.limit(0), ["u"], "y", F.array(F.lit(0)), 1)
    none = choose(Growth(), (0, -1, 0), None, [(1, 0)], np.zeros((1, 2, 1, 3)), [np.arange(3.0)])
    assert none == [(0.0, 0.0, None)]


def test_split_counts_are_the_models_nodes(spark, rows):
    models = growth.boost(rows, [(0, -1, None)], Growth(max_depth=2), 4, 0.3)
    nodes = growth.node_table(spark, models, FEATURES)
    counts = {r["feature"]: r["splits"] for r in growth.split_counts(nodes).collect()}
    own = [FEATURES[f] for t in models[0].trees for f in t.feature if f >= 0]
    assert counts == {f: own.count(f) for f in set(own)}
    assert nodes.where("feature is null").count() == sum(f < 0 for t in models[0].trees for f in t.feature)
    shares = forests.gain_shares(nodes, FEATURES).groupBy("rep").agg(F.sum("share").alias("s")).collect()
    assert [round(r["s"], 9) for r in shares] == [1.0]


def _expected(tree, codes, known, node=0):
    """Expectation of a tree for one row when only the features in `known` are."""
    if tree.feature[node] < 0:
        return tree.value()[node]
    left, right = tree.left[node], tree.left[node] + 1
    if tree.feature[node] in known:
        return _expected(tree, codes, known, left if codes[tree.feature[node]] <= tree.slot[node] else right)
    share = tree.n[left] / tree.n[node]
    return share * _expected(tree, codes, known, left) + (1 - share) * _expected(tree, codes, known, right)


@pytest.mark.parametrize("boosted", (False, True))
def test_attribution_equals_all_subsets(table, rows, boosted):
    if boosted:
        (model,) = growth.boost(rows, [(0, -1, None)], Growth(max_depth=3), 3, 0.5)
    else:
        model = growth.Model(0, -1, 0, growth.grow(rows, [growth.Spec(0, -1, k, Growth(max_depth=4, bootstrap=True)) for k in range(3)]))
    scale, start = (model.rate, model.start) if boosted else (1 / 3, 0.0)
    got = {r["k"]: r for r in attribution.attribute(rows, model, "k", table).collect()}
    assert len(got) == 400
    given = {r["k"]: r for r in table.collect()}
    for key in list(given)[::40]:
        raw = np.array([[-1 if given[key][f] is None else int((given[key][f] > c).sum())] for f, c in zip(FEATURES, rows.cuts, strict=True)])
        codes = rows.placed(0, raw)[:, 0]
        value = lambda known: start + scale * sum(_expected(t, codes, known) for t in model.trees)
        for j, f in enumerate(FEATURES):
            others = [i for i in range(3) if i != j]
            shap = sum(
                factorial(len(s)) * factorial(2 - len(s)) / 6 * (value({*s, j}) - value(set(s))) for k in range(3) for s in combinations(others, k)
            )
            assert np.isclose(got[key][f"shap_{f}"], shap)
        assert np.isclose(got[key]["base"], value(set())) and np.isclose(got[key]["prediction"], value({0, 1, 2}))
        assert np.isclose(got[key]["prediction"], got[key]["base"] + sum(got[key][f"shap_{f}"] for f in FEATURES))


def test_leaf_table_covers_every_row_once(spark, table, rows):
    model = growth.Model(0, -1, 0, growth.grow(rows, [growth.Spec(0, -1, 0, Growth(max_depth=3))]))
    paths = attribution.leaf_table(spark, [model], rows)
    whole = paths.select("leaf", "value", "share").distinct().agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("value")).alias("e")).first()
    assert np.isclose(whole["s"], 1.0) and np.isclose(whole["e"], attribution.expectation(attribution.leaves(model.trees[0])))


def test_paths_over_written_codes_equal_the_walk(rows):
    """A missing value goes where the replicate's mean stands among the bins, without codes of its own for each replicate."""
    grown = Growth(max_depth=4, bootstrap=True)
    trees = growth.grow(rows, [growth.Spec(rep, -1, k, grown) for rep in range(3) for k in range(2)])
    _, codes, _, _ = _collected(rows)
    written = growth.both_ends((codes + 1).astype(np.uint8))
    for tree in trees:
        for depth in (None, 2):
            at = growth.Path.of(tree, rows.layout(), depth).ends(written)
            assert at.dtype == np.uint8 and np.array_equal(at, growth.walk(tree.arrays(), rows.placed(tree.spec.rep, codes), depth))


def test_cells_give_the_trees_of_single_rows(rows, monkeypatch):
    """Rows of equal codes are added up once a replicate where they are many; trees, margins and scores stay the same."""
    kinds = [Growth(3), Growth(3, bootstrap=True, features_per_node=2), Growth(3, drawn=True), Growth(2, subsample=0.5)]
    specs = [growth.Spec(rep, held, rep, g) for rep in range(3) for held in (-1, 1) for g in kinds]
    boosted = [(0, -1, None), (2, 3, (1, 2))]

    def grown():
        trees = growth.grow(rows, specs)
        models = [growth.Model(t.spec.rep, t.spec.held, 0, [t]) for t in trees] + growth.boost(rows, boosted, Growth(max_depth=2), 4, 0.5)
        return models, {r["model"]: r for r in growth.evaluate(rows, models).collect()}

    layout, batches = rows.layout(), rows.blocks.toArrow().combine_chunks().to_batches()
    chunks = list(growth._chunks(iter(batches), layout))
    assert [c.cell is not None for c in chunks] == [True]
    assert chunks[0].codes.shape[1] < len(chunks[0].cell) == 400
    joined, scores = grown()
    monkeypatch.setattr(growth.Rows, "few_cells", property(lambda self: False))
    single = list(growth._chunks(iter(batches), layout))
    assert [c.cell for c in single] == [None]
    for spec, tree in zip(specs, joined, strict=False):
        totals = []
        for chunk in (chunks[0], single[0]):
            path = growth.Path.of(tree.trees[0], layout)
            place = np.full(path.outside + 1, rows.slots)
            place[0 if len(tree.trees[0].feature) == 1 else len(tree.trees[0].feature) - 1] = 0
            totals.append(np.zeros((2, 3, 2 * rows.slots)))
            growth._add_sums(totals[-1], chunk, spec, path, place, range(3), rows.slots, None)
        assert np.allclose(totals[0][:, :, : rows.slots], totals[1][:, :, : rows.slots])
    parts, codes, y, _ = _collected(rows)
    for i, m in enumerate(joined):
        own = parts[:, m.rep] == m.held
        assert np.isclose(scores[i]["mae"], np.abs(y[own] - m.predict(rows.placed(m.rep, codes)[:, own])).mean())


def test_trees_of_few_features_scan_only_those(rows):
    """Sums of features that a tree may not split on are not made; the first still tells the whole node."""
    assert growth._tree_features(growth.Spec(0, -1, 0, Growth(), (1, 2)), 3) == [1, 2]
    (tree,) = growth.grow(rows, [growth.Spec(0, -1, 0, Growth(max_depth=2), (1, 2))])
    parts, _, y, _ = _collected(rows)
    own = parts[:, 0] >= 0
    assert tree.n[0] == own.sum() and np.isclose(tree.total[0], y[own].sum()) and 0 not in tree.feature
