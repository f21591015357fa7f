"""Scenario ranking, point totals, residual bootstrap and contrasts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.expressions import rounded
from ..operators import bootstrap, linear, metrics, reshape, scenario, split
from ..operators.moments import collect_moments, moments
from ..session import materialise
from ..sources import study
from ..sources.tables import FEATURES, KEY, LABEL, TIEBREAK
from .common import SCENARIOS, clipped, fitted, scored
from .oracle import BASE, FITTED, SCORED, is_test, ols, predicted, prep, r, with_
from .registry import query

N2O_FEATURES = ["x_qty", "x_price"]
DRAWS = study.N_SIMULATIONS
SEED = 11


def profile_prediction(features=FEATURES, coef="coef", stats="prepped_stats", src="profiles") -> str:
    """Scenario profiles encoded with training statistics and scored."""
    z = " + ".join(
        f"b{i} * (coalesce({f}, m_{f}) - lo_{f}) / (hi_{f} - lo_{f})" for i, f in enumerate(features, 1)
    )
    return f"b0 + {z}"


PLACES = f"""profiles AS (SELECT place, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM split GROUP BY place),
    ranked_places AS (SELECT place, {profile_prediction()} AS prediction FROM profiles CROSS JOIN prepped_stats CROSS JOIN coef)"""


@query(
    "scenario_ranking",
    with_(
        *FITTED,
        PLACES,
        select=f"SELECT row_number() OVER (ORDER BY prediction DESC, place) AS rank, place, {r('prediction')} AS prediction FROM ranked_places",
    ),
)
def scenario_ranking(spark, sf_dir):
    """Flagship: clip, split, fit, condense to place profiles, score and rank."""
    rows, model = fitted(spark, sf_dir, ["place"])
    ranked, _ = scenario.scenario_ranking(scenario.profiles(rows, "place", FEATURES), model, "place")
    return ranked.select("rank", "place", rounded("prediction").alias("prediction"))


@query(
    "scenario_statistics",
    with_(
        *FITTED,
        PLACES,
        select=f"""SELECT count(*) AS n, {r('max(prediction)')} AS max_value, max_by(place, prediction) AS max_label,
        {r('min(prediction)')} AS min_value, min_by(place, prediction) AS min_label, {r('avg(prediction)')} AS mean,
        {r('stddev_samp(prediction)')} AS std, {r('quantile_cont(prediction, 0.5)')} AS median FROM ranked_places""",
    ),
)
def scenario_statistics(spark, sf_dir):
    rows, model = fitted(spark, sf_dir, ["place"])
    _, stats = scenario.scenario_ranking(scenario.profiles(rows, "place", FEATURES), model, "place")
    return stats.withColumns({c: rounded(c) for c in ("max_value", "min_value", "mean", "std", "median")})


def two_targets(spark, sf_dir):
    """Rows with both splits, and one model per target: seed 0 for the first, seed 1 for the second.

    The prepared rows feed two fits, two residual pools and the profiles, so they are
    written once as a narrow table instead of repeating the joins.
    """
    features = [*FEATURES, "x_price"]
    rows = clipped(spark, sf_dir, [KEY, TIEBREAK, "scenario", *features])
    rows = split.split_threshold(rows, 0, KEY, out="test_ch4")
    rows = materialise(split.split_threshold(rows, 1, KEY, out="test_n2o"), "two-targets")
    ch4 = linear.fit(rows.where(~F.col("test_ch4")), FEATURES, LABEL)
    n2o = linear.fit(rows.where(~F.col("test_n2o")), N2O_FEATURES, LABEL)
    return rows, ch4, n2o


def scenario_points(rows, ch4, n2o):
    """Scenario profiles as legal standards, with the loading rate in litres."""
    profiled = scenario.profiles(rows.where(F.col("scenario").isin(SCENARIOS)), "scenario", [*FEATURES, "x_price"])
    with_rate = profiled.withColumn("hlr_litres", F.col("x_size") * F.lit(10.0))
    return scenario.point_totals(with_rate, ch4.predict(), n2o.predict(), "hlr_litres")


TWO_TARGETS = [
    *BASE[:3],
    f"both_split AS (SELECT *, {is_test(0)} AS test_ch4, {is_test(1)} AS test_n2o FROM clipped)",
    prep(FEATURES, "both_split", "NOT test_ch4", name="p_ch4"),
    prep(N2O_FEATURES, "both_split", "NOT test_n2o", name="p_n2o"),
    ols(FEATURES, "p_ch4", "NOT test_ch4", name="c_ch4"),
    ols(N2O_FEATURES, "p_n2o", "NOT test_n2o", name="c_n2o"),
    f"""profiles AS (SELECT scenario, {', '.join(f'avg({f}) AS {f}' for f in [*FEATURES, 'x_price'])} FROM both_split
        WHERE scenario <> 'AUTOMOBILE' GROUP BY scenario)""",
    f"log_ch4 AS (SELECT scenario, {profile_prediction()} AS log_ch4 FROM profiles CROSS JOIN p_ch4_stats CROSS JOIN c_ch4)",
    f"log_n2o AS (SELECT scenario, {profile_prediction(N2O_FEATURES)} AS log_n2o FROM profiles CROSS JOIN p_n2o_stats CROSS JOIN c_n2o)",
    "points AS (SELECT scenario, log_ch4, log_n2o, coalesce(x_size * 10 / 1000, 0.2::double) AS hlr FROM profiles JOIN log_ch4 USING (scenario) JOIN log_n2o USING (scenario))",
]


def annual(log_flux: str, gwp: int) -> str:
    return f"power(10.0::double, {log_flux}) * 24 / hlr / 1000 * {gwp} / 1000 * 67828164300.0::double / 1000000"


@query(
    "scenario_point_totals",
    with_(
        *TWO_TARGETS,
        select=f"""SELECT scenario, {r('log_ch4')} AS log_ch4, {r('log_n2o')} AS log_n2o, {r('hlr')} AS hlr,
        {r(annual('log_ch4', 28), 0)} AS ch4, {r(annual('log_n2o', 273), 0)} AS n2o,
        {r(f"{annual('log_ch4', 28)} + {annual('log_n2o', 273)}", 0)} AS total FROM points""",
    ),
)
def scenario_point_totals(spark, sf_dir):
    p = scenario_points(*two_targets(spark, sf_dir))
    return p.select(
        "scenario", *[rounded(c).alias(c) for c in ("log_ch4", "log_n2o", "hlr")], *[rounded(c, 0).alias(c) for c in ("ch4", "n2o", "total")]
    )


@query(
    "heldout_residuals",
    with_(
        *SCORED,
        select=f"""SELECT obs_key, tiebreak, {r('y', 4)} AS observed, {r('prediction', 4)} AS predicted, {r('y - prediction', 4)} AS residual,
        x_qty, x_disc, x_size FROM scored WHERE is_test""",
    ),
)
def heldout_residuals(spark, sf_dir):
    rows, _ = scored(spark, sf_dir)
    held = scenario.heldout_residuals(rows, [KEY, TIEBREAK], LABEL, FEATURES)
    return held.withColumns({c: rounded(c, 4) for c in ("observed", "predicted", "residual")})


@query(
    "metric_reproduction_check",
    with_(
        *SCORED,
        """actual AS (SELECT 'test' AS part, 1 - sum(power(y - prediction, 2)) / (count(*) * var_pop(y)) AS r2,
        avg(abs(y - prediction)) AS mae, sqrt(avg(power(y - prediction, 2))) AS rmse FROM scored WHERE is_test)""",
        "long AS (UNPIVOT actual ON r2, mae, rmse INTO NAME metric VALUE v)",
        select=f"""SELECT part, metric, {r("v + CASE WHEN metric = 'mae' THEN 1e-4::double ELSE 0 END")} AS stored, {r('v')} AS actual,
        {r("CASE WHEN metric = 'mae' THEN 1e-4::double ELSE 0 END")} AS diff, metric <> 'mae' AS ok FROM long""",
    ),
)
def metric_reproduction_check(spark, sf_dir):
    """Metrics recomputed from rows against stored ones (test moments), one of them tampered with."""
    rows, _ = scored(spark, sf_dir)
    test = rows.where(F.col("is_test"))
    m = collect_moments(moments(test, ["prediction"], LABEL))[()]
    A = m.second_moments(m.feature_means())
    stored_r2 = linalg.r_squared(A, np.ones(1), 0.0)
    stored_rmse = (linalg.squared_error(A, np.ones(1), 0.0) / m.n) ** 0.5
    mae = test.agg(F.avg(F.abs(F.col(LABEL) - F.col("prediction"))).alias("mae")).scalar()
    stored = spark.range(1).select(
        F.lit("test").alias("part"), F.lit(stored_r2).alias("r2"), F.lit(stored_rmse).alias("rmse"), (mae + F.lit(1e-4)).alias("mae")
    )
    actual = metrics.regression_metrics(test, LABEL, "prediction").withColumn("part", F.lit("test"))
    check = metrics.reproduction_check(actual, stored, ["part"], ["r2", "mae", "rmse"])
    return check.withColumns({c: rounded(c) for c in ("stored", "actual", "diff")})


@query(
    "residual_statistics",
    with_(
        *SCORED,
        select=f"""SELECT count(*) AS n, {r('avg(y - prediction)')} AS mean, {r('stddev_samp(y - prediction)')} AS std,
        {r('min(y - prediction)')} AS "min", {r('max(y - prediction)')} AS "max", {r('sqrt(avg(power(y - prediction, 2)))')} AS rmse
        FROM scored WHERE is_test""",
    ),
)
def residual_statistics(spark, sf_dir):
    rows, _ = scored(spark, sf_dir)
    held = scenario.heldout_residuals(rows, [KEY], LABEL, [])
    s = metrics.residual_statistics(held, "residual")
    return s.withColumns({c: rounded(c) for c in ("mean", "std", "min", "max", "rmse")})


def simulations(spark, sf_dir, analyses=bootstrap.ANALYSES):
    rows, ch4, n2o = two_targets(spark, sf_dir)
    pools = {}
    for target, model in (("ch4", ch4), ("n2o", n2o)):
        held = rows.where(F.col(f"test_{target}")).withColumn("residual", F.col(LABEL) - model.predict())
        pools[target] = bootstrap.residual_pool(held, "residual", KEY, [TIEBREAK], target)
    points = scenario_points(rows, ch4, n2o).select("scenario", "log_ch4", "log_n2o", "hlr")
    return bootstrap.simulate(points, pools, DRAWS, SEED, analyses)


def _pool_sql(target: str, features) -> str:
    return f"""pool_{target} AS (SELECT row_number() OVER (ORDER BY md5(concat('pool_{target}:', obs_key)), obs_key, tiebreak) - 1 AS idx,
        y - ({predicted(len(features))}) AS residual, count(*) OVER () AS n FROM p_{target} CROSS JOIN c_{target} WHERE test_{target})"""


def _index_sql(target: str) -> str:
    text = f"concat_ws(':', '{SEED}', '{target}', simulation, CASE WHEN analysis = 'independent' THEN scenario END)"
    return f"('0x' || substr(md5({text}), 1, 15))::bigint % (SELECT max(n) FROM pool_{target})"


SIMULATED = [
    *TWO_TARGETS,
    _pool_sql("ch4", FEATURES),
    _pool_sql("n2o", N2O_FEATURES),
    f"""draws AS (SELECT analysis, range + 1 AS simulation, points.* FROM points, range({DRAWS}),
        (VALUES ('paired'), ('independent')) t(analysis))""",
    f"indexed AS (SELECT *, {_index_sql('ch4')} AS i_ch4, {_index_sql('n2o')} AS i_n2o FROM draws)",
    f"""simulated AS (SELECT analysis, simulation, scenario, a.residual AS res_ch4, b.residual AS res_n2o,
        {annual('(log_ch4 + a.residual)', 28)} AS ch4, {annual('(log_n2o + b.residual)', 273)} AS n2o, ch4 + n2o AS total
        FROM indexed JOIN pool_ch4 a ON a.idx = i_ch4 JOIN pool_n2o b ON b.idx = i_n2o)""",
]


def _simulation_sql(analysis: str) -> str:
    return with_(
        *SIMULATED,
        select=f"""SELECT simulation::int AS simulation, scenario, {r('res_ch4', 4)} AS res_ch4, {r('res_n2o', 4)} AS res_n2o,
        {r('ch4', -3)} AS ch4, {r('n2o', -3)} AS n2o, {r('total', -3)} AS total FROM simulated WHERE analysis = '{analysis}'""",
    )


def _rounded_simulation(df):
    return df.select(
        "simulation", "scenario", *[rounded(c, 4).alias(c) for c in ("res_ch4", "res_n2o")], *[rounded(c, -3).alias(c) for c in ("ch4", "n2o", "total")]
    )


@query("bootstrap_paired", _simulation_sql("paired"))
def bootstrap_paired(spark, sf_dir):
    return _rounded_simulation(simulations(spark, sf_dir, ["paired"]))


@query("bootstrap_independent", _simulation_sql("independent"))
def bootstrap_independent(spark, sf_dir):
    return _rounded_simulation(simulations(spark, sf_dir, ["independent"]))


def _quantiles(columns, digits=0) -> str:
    return ", ".join(
        f"{r(f'quantile_cont({c}, {q})', digits)} AS {c}_{n}" for c in columns for n, q in (("median", 0.5), ("lower", 0.025), ("upper", 0.975))
    )


@query(
    "uncertainty_summary",
    with_(*SIMULATED, select=f"SELECT analysis, scenario, {_quantiles(bootstrap.TOTALS)} FROM simulated GROUP BY analysis, scenario"),
)
def uncertainty_summary(spark, sf_dir):
    s = bootstrap.uncertainty_summary(simulations(spark, sf_dir), DRAWS)
    return s.select("analysis", "scenario", *[rounded(c, 0).alias(c) for c in s.columns if c not in ("analysis", "scenario")])


CONTRAST = [
    *SIMULATED,
    """contrast AS (SELECT analysis, simulation, max(total) FILTER (scenario = 'BUILDING') AS a, max(total) FILTER (scenario = 'FURNITURE') AS b,
    a - b AS difference, (a - b) / b AS relative FROM simulated GROUP BY analysis, simulation)""",
]


@query(
    "scenario_contrast",
    with_(
        *CONTRAST,
        select=f"""SELECT analysis, simulation::int AS simulation, {r('a', -3)} AS a, {r('b', -3)} AS b, {r('difference', -3)} AS difference,
        {r('relative', 4)} AS relative FROM contrast""",
    ),
)
def scenario_contrast(spark, sf_dir):
    c = bootstrap.scenario_contrast(simulations(spark, sf_dir), "BUILDING", "FURNITURE")
    return c.select("analysis", "simulation", *[rounded(x, -3).alias(x) for x in ("a", "b", "difference")], rounded("relative", 4).alias("relative"))


@query(
    "contrast_summary",
    with_(
        *CONTRAST,
        select=f"""SELECT analysis, {r('avg(CASE WHEN difference > 0 THEN 1.0::double ELSE 0 END)')} AS p_higher,
        {_quantiles(['difference'])}, {_quantiles(['relative'], 6)} FROM contrast GROUP BY analysis""",
    ),
)
def contrast_summary(spark, sf_dir):
    contrast = bootstrap.scenario_contrast(simulations(spark, sf_dir), "BUILDING", "FURNITURE")
    s = bootstrap.contrast_summary(contrast, DRAWS)
    names = ("median", "lower", "upper")
    return s.select(
        "analysis", rounded("p_higher").alias("p_higher"),
        *[rounded(f"difference_{n}", 0).alias(f"difference_{n}") for n in names],
        *[rounded(f"relative_{n}").alias(f"relative_{n}") for n in names],
    )


@query(
    "point_prediction_check",
    with_(
        *FITTED,
        PLACES,
        select=f"""SELECT place, {r("prediction + CASE WHEN place = 'NATION_3' THEN 1e-3::double ELSE 0 END")} AS expected, {r('prediction')} AS prediction,
        {r("CASE WHEN place = 'NATION_3' THEN 1e-3::double ELSE 0 END")} AS diff, place <> 'NATION_3' AS ok FROM ranked_places""",
    ),
)
def point_prediction_check(spark, sf_dir):
    """Predictions of the profiles against values stored from an earlier pass, one of them wrong."""
    rows, model = fitted(spark, sf_dir, ["place"])
    predictions = scenario.score(model, scenario.profiles(rows, "place", FEATURES)).select("place", "prediction")
    wrong = F.when(F.col("place") == "NATION_3", 1e-3).otherwise(0.0)
    stored = materialise(predictions.select("place", (F.col("prediction") + wrong).alias("expected")), "stored-points")
    check = scenario.point_prediction_check(predictions, "place", stored)
    return check.withColumns({c: rounded(c) for c in ("expected", "prediction", "diff")})
