"""Moment-based learners against row-level solutions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from terraquant.functions import linalg
from terraquant.operators import linear, search, select
from terraquant.operators.moments import collect_conditioned
from terraquant.plans.common import clipped
from terraquant.sources.tables import FEATURES, KEY, LABEL

RNG = np.random.default_rng(11)
N = 400


def rows(offset=0.0):
    x = RNG.normal(offset, 2.0, (N, 3))
    x[:, 2] += x[:, 0]
    y = 1.5 * x[:, 0] - 2.0 * x[:, 1] + 0.3 * x[:, 2] + RNG.normal(0, 0.5, N)
    gaps = RNG.random((N, 3)) < 0.2
    return x, y, gaps


def frame(spark, x, y, gaps):
    data = [(f"r{i}", *[None if gaps[i, j] else float(x[i, j]) for j in range(3)], float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(data, "key string, a double, b double, c double, y double").repartition(5)


def encode(x, gaps, scale=True):
    x = np.where(gaps, np.nan, x)
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    return (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0)) if scale else x


def ridge_by_hand(z, y, alpha):
    zc, yc = z - z.mean(axis=0), y - y.mean()
    beta = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
    return beta, y.mean() - beta @ z.mean(axis=0)


@pytest.mark.parametrize("scale", [True, False])
@pytest.mark.parametrize("offset", [0.0, 1e5])
@pytest.mark.parametrize("learner,alpha", [("ols", 0.0), ("ridge", 10.0)])
def test_fit_with_gaps(spark, learner, alpha, offset, scale):
    x, y, gaps = rows(offset)
    model = linear.fit(frame(spark, x, y, gaps), ["a", "b", "c"], "y", learner, alpha, scale)
    beta, intercept = ridge_by_hand(encode(x, gaps, scale), y, alpha)
    np.testing.assert_allclose(model.coef, beta, rtol=1e-6)
    np.testing.assert_allclose(model.intercept, intercept, rtol=1e-6)


def test_far_from_zero_columns_are_centred(spark):
    x, y, gaps = rows(1e6)
    _, centres = collect_conditioned(frame(spark, x, y, gaps), ["a", "b", "c"], "y")
    assert centres
    x, y, gaps = rows(1.0)
    _, centres = collect_conditioned(frame(spark, x, y, gaps), ["a", "b", "c"], "y")
    assert not centres


def test_lasso_meets_the_optimality_conditions(spark):
    x, y, gaps = rows()
    alpha = 0.05
    model = linear.fit(frame(spark, x, y, gaps), ["a", "b", "c"], "y", "lasso", alpha)
    z = encode(x, gaps)
    residual = y - model.intercept - z @ np.array(model.coef)
    gradient = (z - z.mean(axis=0)).T @ residual / N
    for b, g in zip(model.coef, gradient):
        assert abs(g - alpha * np.sign(b)) < 1e-9 if b else abs(g) <= alpha + 1e-9


@pytest.mark.parametrize("learner,alpha", [("ols", 0.0), ("lasso", 0.05)])
def test_against_spark_ml(spark, learner, alpha):
    x, y, _ = rows()
    none = np.zeros_like(x, dtype=bool)
    df = frame(spark, x, y, none)
    ours = linear.fit(df, ["a", "b", "c"], "y", learner, alpha, scale=False)
    ml = LinearRegression(
        labelCol="y", regParam=alpha, elasticNetParam=1.0 if alpha else 0.0, standardization=False, tol=1e-13, maxIter=5000,
        solver="normal" if not alpha else "auto",
    ).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    np.testing.assert_allclose(ours.coef, ml.coefficients.toArray(), atol=1e-5)


def test_collinear_and_constant_features(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.lit(3.0).alias("c"), (F.col("id") * 1.0 + 1).alias("y"))
    model = linear.fit(df, ["a", "b", "c"], "y")
    worst = df.select(F.max(F.abs(F.col("y") - model.predict())).alias("e")).first()["e"]
    assert worst < 1e-9
    assert model.coef[2] == 0.0 or abs(model.coef[2]) < 1e-12


@pytest.mark.parametrize("scope", ["train", "fold"])
def test_runs_against_row_level_cross_validation(spark, scope):
    x, y, gaps = rows()
    df = frame(spark, x, y, gaps)
    got = {
        (r["seed"], r["alpha"]): r
        for r in linear.runs(df, ["a", "b", "c"], "y", "key", 5, {"ridge": [0.1, 20.0]}, folds=3, scope=scope).collect()
    }
    assert len(got) == 10
    for seed in (0, 4):
        parts = search.seed_parts(df, "key", seed, 3).toPandas().set_index("key").loc[[f"r{i}" for i in range(N)]]
        test, fold = parts["is_test"].to_numpy(), parts["fold"].to_numpy()
        raw = np.where(gaps, np.nan, x)

        def fitted(on):
            mean = np.nanmean(raw[on], axis=0)
            low, high = np.nanmin(raw[on], axis=0), np.nanmax(raw[on], axis=0)
            return lambda v: (np.where(np.isnan(v), mean, v) - low) / (high - low)

        def r2(t, p):
            return 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum()

        for alpha in (0.1, 20.0):
            whole = fitted(~test)
            scores = []
            for f in range(3):
                on, held = ~test & (fold != f), ~test & (fold == f)
                enc = whole if scope == "train" else fitted(on)
                b, c = ridge_by_hand(enc(raw[on]), y[on], alpha)
                scores.append(r2(y[held], enc(raw[held]) @ b + c))
            b, c = ridge_by_hand(whole(raw[~test]), y[~test], alpha)
            r = got[(seed, alpha)]
            np.testing.assert_allclose(r["cv_r2"], np.mean(scores), rtol=1e-9)
            np.testing.assert_allclose(r["test_r2"], r2(y[test], whole(raw[test]) @ b + c), rtol=1e-9)
            assert r["n_test"] == test.sum()


def test_runs_do_not_depend_on_partitioning(spark, sf_dir):
    rows_ = clipped(spark, sf_dir, [KEY, *FEATURES])
    def table(parts):
        return {r["seed"]: r["test_r2"] for r in linear.runs(rows_.repartition(parts), FEATURES, LABEL, KEY, 3, {"ols": [0.0]}).collect()}
    one, many = table(1), table(8)
    assert one.keys() == many.keys()
    for s in one:
        assert abs(one[s] - many[s]) < 1e-10


def test_saved_stage_predicts_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel

    x, y, gaps = rows()
    df = frame(spark, x, y, gaps)
    model = linear.fit(df, ["a", "b", "c"], "y")
    model.as_stage().write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m")).transform(df).withColumn("direct", model.predict())
    assert back.select(F.max(F.abs(F.col("prediction") - F.col("direct"))).alias("d")).first()["d"] < 1e-12


def test_prefix_scores_find_the_noise(spark, sf_dir):
    df = clipped(spark, sf_dir, [KEY, "x_qty", "x_size", "x_price"]).withColumn("fold", F.pmod(F.hash(KEY), F.lit(4)))
    curve = select.forward_prefix_cv(df, ["x_size", "x_price", "x_qty"], LABEL, "fold").orderBy("rank").collect()
    assert curve[0]["feature"] == "x_qty"
    assert curve[0]["mean_r2"] > 0.7
    assert abs(sum(r["share"] for r in curve) - 1) < 1e-12
    assert all(r["ci_low"] <= r["mean_r2"] <= r["ci_high"] for r in curve)


def test_student_and_normal_tails():
    assert abs(linalg.student_quantile(0.975, 4) - 2.7764451051977987) < 1e-10
    assert abs(linalg.student_quantile(0.975, 1) - 12.706204736432095) < 1e-8
    assert abs(linalg.student_two_sided(2.0, 10) - 0.07338803477074037) < 1e-12
    assert abs(linalg.normal_two_sided(1.959963984540054) - 0.05) < 1e-14
