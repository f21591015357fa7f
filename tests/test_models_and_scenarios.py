"""Attribution, bootstrap, scenario totals, artefacts, run tables, streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.operators import bootstrap, clean, contracts, explain, linear, metrics, prep, reshape, runs, scenario, search, split, trees
from terraquant.plans.common import fitted, split_rows
from terraquant.sources import artefacts, study
from terraquant.sources.tables import FEATURES, KEY, LABEL, TIEBREAK, observations


# Arithmetic of the four standards by the study formula, not published (t CO2-eq per year at HLR 0.2).
TOTALS = {"Class I-A": 163995.2038, "Class I-B": 101453.2714, "Class II": 114118.4006, "Class III": 550343.6026}


def standards(spark):
    rows = [(s, *study.POINT_PREDICTIONS[s], "200") for s in study.STANDARDS]
    return spark.createDataFrame(rows, "scenario string, p_ch4 double, p_n2o double, HLR string")


def test_point_totals_of_the_standards(spark):
    got = scenario.point_totals(standards(spark), F.col("p_ch4"), F.col("p_n2o"), "HLR")
    for r in got.collect():
        assert abs(r["total"] - TOTALS[r["scenario"]]) < 1e-3
        assert r["hlr"] == 0.2


def test_missing_rate_takes_the_default(spark):
    df = spark.createDataFrame([("n/a",), (None,), ("NaN",), ("400",)], "HLR string")
    from terraquant.functions.expressions import litres_to_cubic_metres

    assert [r[0] for r in df.select(litres_to_cubic_metres("HLR", 0.2)).collect()] == [0.2, 0.2, 0.2, 0.4]


def test_bootstrap_pairs_and_independence(spark):
    held = spark.range(400).select(F.concat(F.lit("h"), F.col("id")).alias("key"), (F.col("id") / 400.0 - 0.5).alias("residual"))
    pools = {t: bootstrap.residual_pool(held, "residual", "key", [], t) for t in ("ch4", "n2o")}
    points = scenario.point_totals(standards(spark), F.col("p_ch4"), F.col("p_n2o"), "HLR").select("scenario", "log_ch4", "log_n2o", "hlr")
    draws = 2500
    sims = bootstrap.simulate(points, pools, draws, 7).toPandas()
    assert len(sims) == draws * 4 * 2
    paired = sims[sims.analysis == "paired"]
    assert (paired.groupby("simulation").res_ch4.nunique() == 1).all()
    independent = sims[sims.analysis == "independent"]
    assert (independent.groupby("simulation").res_ch4.nunique() > 1).mean() > 0.95
    assert abs(sims.res_ch4.mean()) < 0.02 and abs(np.corrcoef(paired.res_ch4, paired.res_n2o)[0, 1]) < 0.05
    again = bootstrap.simulate(points.repartition(5), pools, draws, 7).toPandas()
    assert np.isclose(again.total.sum(), sims.total.sum())


def test_contrast_and_duplicate_pivot(spark):
    sims = spark.createDataFrame([("x", 1, "A", 3.0), ("x", 1, "B", 2.0), ("x", 2, "A", 1.0), ("x", 2, "B", 4.0)], "analysis string, simulation int, scenario string, total double")
    c = bootstrap.scenario_contrast(sims, "A", "B")
    assert {(r["simulation"], r["difference"], r["relative"]) for r in c.collect()} == {(1, 1.0, 0.5), (2, -3.0, -0.75)}
    s = bootstrap.contrast_summary(c, 2).first()
    assert s["p_higher"] == 0.5 and s["difference_median"] == -1.0
    with pytest.raises(Exception, match="duplicate entries"):
        bootstrap.scenario_contrast(sims.unionByName(sims), "A", "B").collect()


@pytest.mark.parametrize("draws", [1, 999, 1000, 1001, 4321])
def test_expand_draws(spark, draws):
    got = bootstrap.expand_draws(spark.createDataFrame([("a",), ("b",)], "s string"), draws)
    r = got.agg(F.count(F.lit(1)), F.count_distinct("s", "simulation"), F.min("simulation"), F.max("simulation")).first()
    assert tuple(r) == (2 * draws, 2 * draws, 1, draws)


def test_sampled_shapley_is_exact_for_a_linear_model(spark, sf_dir):
    rows, model = fitted(spark, sf_dir)
    train = rows.where(~F.col("is_test"))
    some = rows.where(F.col("tiebreak") > 50000)
    values = explain.shap_sampled(some, model, FEATURES, [KEY, TIEBREAK], train, permutations=4, background_rows=1)
    one = values.withColumn("gap", F.abs(F.col("prediction") - F.col("base") - sum(F.col(f"shap_{f}") for f in FEATURES)))
    assert one.agg(F.max("gap")).first()[0] < 1e-9
    # With one background row every permutation gives the slope times the distance from it.
    exact = explain.shap_wide(some, model).select(KEY, TIEBREAK, *[F.col(f"shap_{f}").alias(f"e_{f}") for f in FEATURES])
    both = values.join(exact, [KEY, TIEBREAK])
    for f in FEATURES:
        spread = both.select(F.stddev_pop(F.col(f"shap_{f}") - F.col(f"e_{f}")).alias("s")).first()["s"]
        assert spread < 1e-9


def test_sampled_shapley_of_a_forest_sums_up(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    train = rows.where(~F.col("is_test"))
    model = trees.fit_tree(train, FEATURES, LABEL, "random_forest", numTrees=4, maxDepth=4)
    values = explain.shap_sampled(rows, model, FEATURES, [KEY, TIEBREAK], train, permutations=2, background_rows=10)
    gap = values.select(F.max(F.abs(F.col("prediction") - F.col("base") - sum(F.col(f"shap_{f}") for f in FEATURES)))).first()[0]
    assert gap < 1e-9
    assert values.count() == rows.select(KEY, TIEBREAK).distinct().count()


def test_tree_learners_beat_the_mean(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    train, test = rows.where(~F.col("is_test")), rows.where(F.col("is_test"))
    for kind, params in {
        "decision_tree": {"maxDepth": 6}, "random_forest": {"numTrees": 6, "maxDepth": 6},
        "extra_trees": {"numTrees": 6, "maxDepth": 6}, "xgboost": {"maxIter": 5, "stepSize": 0.4},
    }.items():
        model = trees.fit_tree(train, FEATURES, LABEL, kind, **params)
        assert metrics.regression_metrics(trees.predictions(model, test), LABEL, "prediction").first()["r2"] > 0.6, kind
        assert abs(sum(trees.importances(model, FEATURES).values()) - 1) < 1e-9


def test_knn_and_tree_run_tables(spark, sf_dir):
    rows = observations(spark, sf_dir, [KEY, "x_qty", "x_size", LABEL]).where("x_size < 10")
    features = ["x_qty", "x_size"]
    knn_table = search.knn_run_table(rows, features, LABEL, KEY, [0], {"k": [3, 5], "weights": ["uniform"], "p": [2]}, folds=2)
    tree_table = search.tree_run_table(rows, features, LABEL, KEY, [0, 1], "decision_tree", {"maxDepth": [2, 5]}, folds=2)
    table = knn_table.unionByName(tree_table)
    assert {tuple(r) for r in runs.compare_models(table).select("model", "runs").collect()} == {("knn", 1), ("decision_tree", 2)}
    assert all(r["test_r2"] > 0.5 for r in table.collect())
    assert {r["feature"] for r in runs.mean_importance(tree_table).collect()} == set(features)
    for rule in ("typical", "max_cv"):
        assert search.choose_run(table, rule).count() == 2


def test_typical_run_takes_the_first_on_ties(spark):
    t = spark.createDataFrame([("m", 3, 0.4), ("m", 1, 0.6), ("m", 2, 0.5), ("m", 0, 0.5)], "model string, seed int, test_r2 double")
    assert runs.closest_to_mean_run(t).first()["seed"] == 0


def test_splits(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, TIEBREAK])
    n = obs.count()
    exact = split.split_exact(obs, 3, KEY, [TIEBREAK])
    assert exact.where("is_test").count() == -(-3 * n // 10)
    assert split.split_exact(obs.repartition(3), 3, KEY, [TIEBREAK]).exceptAll(exact).count() == 0
    threshold = split.split_threshold(obs, 6, KEY)
    replicated = split.replicate_splits(obs, 8, KEY).where("seed = 6").drop("seed")
    assert threshold.exceptAll(replicated).count() == 0
    sizes = sorted(r["count"] for r in split.kfold_contiguous(obs, 7, 1, KEY, [TIEBREAK]).groupBy("fold").count().collect())
    assert len(sizes) == 7 and sizes[-1] - sizes[0] <= 1 and sum(sizes) == n


def test_small_tables_have_small_folds(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "key string, t int")
    assert {r["fold"] for r in split.kfold_contiguous(df, 5, 0, "key", ["t"]).collect()} == {0, 1, 2}


def test_preprocessing_of_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, 5.0, False), (3.0, None, False), (None, 5.0, True), (9.0, 5.0, True)], "a double, b double, is_test boolean")
    out = prep.apply_preprocessing(df, prep.fit_preprocessing(df, ["a", "b"], train=~F.col("is_test")), ["a", "b"])
    assert [(r["a"], r["b"]) for r in out.collect()] == [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0), (4.0, 0.0)]


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("c", 2.0, 2.0), ("c", 2.0, 2.0), ("d", 2.0, 3.0), ("d", 2.0, 2.0)], "g string, y double, p double")
    got = {r["g"]: r["r2"] for r in metrics.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert got == {"c": 1.0, "d": 0.0}


def test_interval_summary_of_many_and_of_large_groups(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") < 1500, F.col("id")).when(F.col("id") < 1501, None).otherwise(-1 - F.col("id") % 2).alias("g"),
        F.pow(F.col("id"), F.lit(1.5)).alias("v"),
        F.when(F.col("id") != 7, -F.col("id").cast("double")).alias("w"),
    )
    got = {r["g"]: tuple(r)[1:] for r in reshape.interval_summary(df, ["g"], ["v", "w"]).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append((r["v"], r["w"]))
    assert set(got) == set(groups) and len(groups) == 1503
    for g, rows in groups.items():
        for i in (0, 1):
            values = [x[i] for x in rows if x[i] is not None]
            expected = np.quantile(values, [0.5, 0.025, 0.975]) if values else [None] * 3
            if values:
                np.testing.assert_allclose(got[g][3 * i : 3 * i + 3], expected, rtol=1e-12)
            else:
                assert got[g][3 * i : 3 * i + 3] == (None, None, None)


def test_point_check_covers_every_stored_label(spark):
    predictions = spark.range(1400).selectExpr("cast(id AS string) AS label", "id * 1.0D AS prediction")
    stored = spark.range(1500).selectExpr("cast(id AS string) AS label", "id + if(id = 1300, 0.5D, 0.0D) AS expected")
    got = {r["label"]: r["ok"] for r in scenario.point_prediction_check(predictions, "label", stored).collect()}
    assert len(got) == 1500 and {k for k, ok in got.items() if not ok} == {"1300", *map(str, range(1400, 1500))}


def test_t_interval_of_any_number_of_scores(spark):
    from terraquant.functions.linalg import student_quantile

    df = spark.range(3000).selectExpr("CASE WHEN id < 60 THEN 'a' WHEN id < 1060 THEN 'b' WHEN id < 1061 THEN 'c' ELSE 'd' END AS g", "sin(id) AS v")
    got = {r["g"]: r for r in reshape.t_confidence_interval(df, ["g"], "v").collect()}
    for g, ids in {"a": range(60), "b": range(60, 1060), "d": range(1061, 3000)}.items():
        v = np.sin(list(ids))
        half = student_quantile(0.975, len(v) - 1) * v.std(ddof=1) / np.sqrt(len(v))
        np.testing.assert_allclose([got[g]["ci_low"], got[g]["ci_high"]], [v.mean() - half, v.mean() + half], atol=1e-9)
    assert got["c"]["ci_low"] is None and got["c"]["mean"] is not None


def test_rank_of_many_rows(spark):
    df = spark.range(150_000).selectExpr("id AS label", "pmod(id * 7919, 1000) AS v")
    got = reshape.rank_desc(df, "v", "label").collect()
    expected = sorted(got, key=lambda r: (-r["v"], r["label"]))
    assert len(got) == 150_000 and [r["rank"] for r in expected] == list(range(1, 150_001))


def test_closure_of_a_complete_graph(spark):
    from terraquant.operators import graph

    edges = graph.edge_table(spark, {"k40": [(f"n{i:02}", f"n{j:02}") for i in range(40) for j in range(i)]})
    assert graph.ancestors(edges).count() == 40 * 39 // 2


def test_contracts(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", None)], "label string, x double")
    with pytest.raises(ValueError, match="missing columns"):
        contracts.require_columns(df, ["x", "z"])
    report = contracts.check_row_contract(df, {"rows": ("3", F.count(F.lit(1)))})
    with pytest.raises(ValueError, match="rows"):
        contracts.require_ok(report, "row contract")
    assert contracts.numeric_columns(df) == [("x", "double")]


def test_clipping_keeps_both_ends_and_drops_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "y double")
    b = clean.quantile_bounds(df, "y")
    assert (b.low, b.high, b.rows) == (1.0, 99.0, 101)
    assert clean.clip_by_quantile(df, "y").count() == 99
    report = clean.clip_report(df, "y", b).first()
    assert (report["kept"], report["removed"]) == (99, 3)
    approx = clean.quantile_bounds(df, "y", approx=True)
    assert abs(approx.low - 1) <= 1 and abs(approx.high - 99) <= 1


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "in.csv").write_text("﻿id,residual\n1,0.5\n2,\n3,oops\n4,NaN\n5,-1e-3\n", encoding="utf-8")
    back = artefacts.read_csv_with_bom(spark, str(tmp_path / "in.csv"), ["id", "residual"])
    assert back.columns == ["id", "residual"]
    got = artefacts.numeric_column(back, "residual", keep=["id"])
    assert [(r["id"], r["residual"]) for r in got.orderBy("id").collect()] == [("1", 0.5), ("5", -0.001)]
    artefacts.write_csv_with_bom(got, str(tmp_path / "out"))
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")


def test_metadata_file_with_dotted_names(spark, tmp_path):
    record = {
        "chosen_run": 4, "random_state": 3, "split": {"train": 0.7, "test": 0.3}, "cv": 10, "metrics": {"test_R2": 0.5, "test_MAE": 0.4, "test_RMSE": 0.6},
        "best_params": {"n_estimators": 600}, "selected_features": ["a", "b"], "target": "CH4",
        "clip_quantiles": {"low_0.01": 0.1, "high_0.99": 5.4},
    }
    (tmp_path / "m.json").write_text(json.dumps(record, indent=2))
    m = artefacts.read_metadata(spark, str(tmp_path / "m.json"))
    r = m.select("target", "selected_features", F.col("clip_quantiles.`low_0.01`").alias("low"), F.col("best_params")["n_estimators"].alias("n")).first()
    assert tuple(r) == ("CH4", ["a", "b"], 0.1, "600")
    ok = contracts.check_metadata_contract(m, {"target": "CH4", "split.test": 0.3, "cv": 5})
    assert {r["item"]: r["ok"] for r in ok.collect()} == {"target": True, "split.test": True, "cv": False}


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"\x00\x01")
    r = artefacts.file_hashes(spark, str(tmp_path / "d")).first()
    assert r["path"].endswith("a.bin") and r["sha256"] == hashlib.sha256(b"\x00\x01").hexdigest()


def test_stream_scores_like_batch(spark, sf_dir, tmp_path):
    from terraquant.streaming.score import start_scoring

    rows, model = fitted(spark, sf_dir)
    rows.select(KEY, *FEATURES).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    start_scoring(stream, model, [KEY], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = rows.select(KEY, model.predict().alias("prediction"))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0
