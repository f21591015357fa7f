"""Effects, refuters, independence tests and falsification on synthetic graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.operators import effects, falsify, graph

RNG = np.random.default_rng(8)
N = 1500
EDGES = [("c", "t"), ("c", "y"), ("t", "y"), ("w", "y")]


@pytest.fixture(scope="module")
def data(spark):
    c = RNG.normal(size=N)
    w = RNG.normal(size=N)
    t = 0.8 * c + RNG.normal(size=N)
    y = 2.0 * t - 1.0 * c + 0.5 * w + RNG.normal(size=N)
    rows = [(f"k{i}", float(c[i]), float(w[i]), float(t[i]), float(y[i])) for i in range(N)]
    return spark.createDataFrame(rows, "key string, c double, w double, t double, y double").repartition(4), (c, w, t, y)


def test_backdoor_effect_and_its_error(data):
    df, (c, w, t, y) = data
    X = np.column_stack([np.ones(N), t, c])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    residual = y - X @ beta
    error = np.sqrt(residual @ residual / (N - 3) * np.linalg.inv(X.T @ X)[1, 1])
    r = effects.backdoor_effects(df, EDGES, ["t"], "y").first()
    np.testing.assert_allclose([r["effect"], r["std_error"]], [beta[1], error], rtol=1e-8)
    assert r["ci_low"] < 2.0 < r["ci_high"]
    assert r["p_value"] < 1e-12


def test_scaled_effect_is_per_range(data):
    df, (c, w, t, y) = data
    plain = effects.backdoor_effects(df, EDGES, ["t"], "y").first()["effect"]
    scaled = effects.backdoor_effects(df, EDGES, ["t"], "y", scale=True).first()["effect"]
    np.testing.assert_allclose(scaled, plain * (t.max() - t.min()), rtol=1e-8)


def test_refuters(data):
    df, _ = data
    effect = effects.backdoor_effects(df, EDGES, ["t", "w"], "y")
    refuted = effects.refutations(df, EDGES, ["t", "w"], "y", "key", reps=12)
    assert refuted.count() == 2 * 3 * 12
    for r in effects.effect_report(effect, refuted).collect():
        assert abs(r["random_common_cause"] - r["effect"]) < 0.02
        assert abs(r["placebo_treatment"]) < 0.2
        assert abs(r["data_subset"] - r["effect"]) < 0.05


def test_unknown_treatment(data):
    with pytest.raises(ValueError, match="unknown treatments"):
        effects.backdoor_effects(data[0], EDGES, ["z"], "y")


def test_graph_validation():
    with pytest.raises(ValueError, match="cycle"):
        graph.validate({"g": [("a", "b"), ("b", "c"), ("c", "a")]}, ["a", "b", "c"])
    with pytest.raises(ValueError, match="without a data column"):
        graph.validate({"g": [("a", "b")]}, ["a"])


def test_closure_and_conditions(spark):
    edges = graph.edge_table(spark, {"g": [("a", "b"), ("b", "c"), ("d", "c")]})
    closure = {(r["node"], r["ancestor"]) for r in graph.ancestors(edges).collect()}
    assert closure == {("b", "a"), ("c", "a"), ("c", "b"), ("c", "d")}
    conditions = {(r["x"], r["y"], tuple(r["given"])) for r in graph.implied_independencies(edges).collect()}
    assert conditions == {("a", "d", ()), ("b", "d", ("a",)), ("c", "a", ("b", "d")), ("d", "a", ()), ("d", "b", ())}


@pytest.mark.parametrize("learner,params", [("linear", {}), ("gbt", {"rounds": 20, "rate": 0.3, "max_depth": 3})])
def test_independence(data, learner, params):
    tests = [("c", "w", ()), ("t", "y", ("c",)), ("t", "w", ("c",))]
    p = {t[:2]: t[4] for t in falsify.independence_tests(data[0], tests, learner, **params)}
    assert p[("c", "w")] > 0.001
    assert p[("t", "y")] < 1e-9
    assert p[("t", "w")] > 0.001


def test_falsification_prefers_the_true_graph(spark):
    a = RNG.normal(size=N)
    b = a + RNG.normal(size=N) * 0.7
    c = b + RNG.normal(size=N) * 0.7
    d = c + RNG.normal(size=N) * 0.7
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, d)], "a double, b double, c double, d double")
    graphs = {
        "true": [("a", "b"), ("b", "c"), ("c", "d")],
        "wrong": [("a", "c"), ("c", "b"), ("b", "d")],
    }
    report = {r["graph"]: r for r in falsify.falsify_graphs(df, graphs, permutations=40, significance=0.01).collect()}
    assert report["true"]["violations"] < report["wrong"]["violations"]
    assert report["true"]["p_violations"] <= 0.2
    assert report["true"]["permutations"] == 40


def test_partition_invariance(data):
    df, _ = data
    tests = [("t", "y", ("c", "w"))]
    one = falsify.independence_tests(df.repartition(1), tests)[0][3]
    many = falsify.independence_tests(df.repartition(6), tests)[0][3]
    assert abs(one - many) < 1e-9


def test_replicated_moments_equal_sums_over_rows(spark, monkeypatch):
    """Groups, gaps, rows without a key, an extra feature, and ranges of a group that no row near an end belongs to."""
    from terraquant.functions.hashing import Drawn, drawn_text, numbered_draws, seed_draws
    from terraquant.functions.linalg import Moments
    from terraquant.operators import moments

    monkeypatch.setattr(moments, "EXTREME_ROWS", 3)
    rng = np.random.default_rng(5)
    given = [
        (None if i % 13 == 0 else f"k{i}", None if i % 7 == 0 else float(rng.normal()), float(rng.integers(0, 4)), float(rng.normal())) for i in range(300)
    ]
    df = spark.createDataFrame(given, "k string, a double, b double, y double").repartition(3)
    reps, limit = 6, 2**30
    told = seed_draws(df, reps, "k").withColumn("own", numbered_draws("k", reps, "t")).collect()
    kept = [r for r in told if r["k"] is not None]
    draws = np.array([[int(d, 16) for d in r["draws"]] for r in kept])
    text = df.select("k", drawn_text("k", reps, "t").alias("t")).where("k is not null").collect()
    own = {r["k"]: [int(r["t"][8 * i : 8 * i + 8], 16) for i in range(reps)] for r in text}
    assert all(own[r["k"]] == r["own"] for r in kept)

    code = lambda d: np.where(d < limit, -1, (d % 2).astype(np.int8))
    noise = lambda d: d / 2.0**32
    values = np.array([[np.nan if r[c] is None else r[c] for c in ("a", "b")] for r in kept])
    y = np.array([r["y"] for r in kept])
    made = moments.replicated_moments(df, ["a", "b"], "y", Drawn(drawn_text("k", reps), reps), (-1, 0, 1), code, noise, {"a": 0.5}).collect()
    assert len(made) == 3 * reps
    for r in made:
        inside = code(draws)[:, r["rep"]] == r["code"]
        x = np.column_stack([values[inside] - [0.5, 0.0], noise(draws[inside, r["rep"]]), y[inside]])
        m = Moments.unpack(r["n"], r["sums"], r["lows"], r["highs"])
        gap, filled = np.isnan(x[:, :3]), np.nan_to_num(x)
        assert m.n == inside.sum() and np.allclose(m.s, filled.sum(axis=0)) and np.allclose(m.S, filled.T @ filled)
        assert np.allclose(m.N, gap.T.astype(float) @ gap) and np.isclose(m.M[3, 0], y[inside][gap[:, 0]].sum())
        assert np.allclose(m.low, np.nanmin(x[:, :3], axis=0)) and np.allclose(m.high, np.nanmax(x[:, :3], axis=0))
