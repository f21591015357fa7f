"""Aggregations, reshapes, rankings and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import reshape, runs
from ..operators.linear import best_cells, runs as gram_runs, with_test_mae
from ..sources import study
from ..sources.tables import ALL_FEATURES, FEATURES, KEY, LABEL, TIEBREAK, observations
from .common import clipped, scored
from .oracle import BASE, OBS, SCORED, draw, is_test, predicted, prep, r, sweep, coefficients, gram, with_
from .registry import query

RUN_SEEDS = 50


@query(
    "null_profile",
    with_(
        OBS,
        select=" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS total FROM obs" for c in ALL_FEATURES),
    ),
)
def null_profile(spark, sf_dir):
    return reshape.null_profile(observations(spark, sf_dir, ALL_FEATURES), ALL_FEATURES)


@query(
    "describe_features",
    with_(
        OBS,
        select=" UNION ALL ".join(
            f"""SELECT '{c}' AS feature, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
            {r(f'min({c})')} AS "min", {r(f'max({c})')} AS "max" FROM obs"""
            for c in ALL_FEATURES
        ),
    ),
)
def describe_features(spark, sf_dir):
    d = reshape.describe_features(observations(spark, sf_dir, ALL_FEATURES), ALL_FEATURES)
    return d.select("feature", *[rounded(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(
    "result_statistics",
    with_(
        *SCORED,
        select=f"""SELECT count(*) AS n, {r('max(prediction)')} AS max_value,
        (SELECT obs_key FROM scored ORDER BY prediction DESC, obs_key LIMIT 1) AS max_label,
        {r('min(prediction)')} AS min_value, (SELECT obs_key FROM scored ORDER BY prediction, obs_key LIMIT 1) AS min_label,
        {r('avg(prediction)')} AS mean, {r('stddev_samp(prediction)')} AS std, {r('quantile_cont(prediction, 0.5)')} AS median FROM scored""",
    ),
)
def result_statistics(spark, sf_dir):
    rows, _ = scored(spark, sf_dir)
    s = reshape.result_statistics(rows.select(KEY, "prediction"), KEY, "prediction")
    return s.withColumns({c: rounded(c) for c in ("max_value", "min_value", "mean", "std", "median")})


def runs_sql(seeds: int, learners: dict[str, list[float]], folds: int = 5) -> list[str]:
    """Run table in SQL: one row per seed and learner, best alpha by cross-validated R2, held-out metrics."""
    p = len(FEATURES)
    zs = [f"z{i}" for i in range(1, p + 1)]
    cells = [(name, float(a)) for name, alphas in learners.items() for a in alphas]
    values = ", ".join(f"({i}, '{name}', {a}::double)" for i, (name, a) in enumerate(cells))
    test = is_test("seed")
    return [
        f"""seeded AS (SELECT clipped.*, seed, {test} AS is_test, CASE WHEN {test} THEN -1 ELSE {draw('seed')} % {folds} END AS part
            FROM clipped CROSS JOIN (SELECT range AS seed FROM range({seeds})) seeds)""",
        prep(FEATURES, "seeded", by="seed"),
        f"cells AS (SELECT * FROM (VALUES {values}) t(cell, learner, alpha))",
        # held = -1 keeps every training row; held = k leaves fold k out
        f"""holdouts AS (SELECT range - 1 AS held FROM range({folds + 1}))""",
        gram(zs, "y", "(SELECT * FROM prepped, holdouts WHERE part <> -1 AND part <> held)", by=["seed", "held"], name="raw_gram"),
        "penalised AS (SELECT raw_gram.* REPLACE ("
        + ", ".join(f"a{i}_{i} + alpha AS a{i}_{i}" for i in range(1, p + 1))
        + "), cell, learner, alpha FROM raw_gram CROSS JOIN cells)",
        sweep(p, "penalised", ["seed", "held", "cell", "learner", "alpha"], name="w"),
        coefficients(p, f"w{p}", ["seed", "held", "cell", "learner", "alpha"], name="fits"),
        f"""fold_scores AS (SELECT seed, cell, learner, alpha, held,
            1 - sum(power(y - ({predicted(p)}), 2)) / (count(*) * var_pop(y)) AS r2
            FROM prepped JOIN fits USING (seed) WHERE part = held AND held >= 0 GROUP BY ALL)""",
        "cv AS (SELECT seed, cell, learner, alpha, avg(r2) AS cv_r2 FROM fold_scores GROUP BY ALL)",
        "chosen AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY seed, learner ORDER BY cv_r2 DESC, cell) = 1)",
        f"""run_table AS (SELECT c.seed, c.learner, c.alpha, any_value(c.cv_r2) AS cv_r2, count(*) AS n_test,
            1 - sum(power(y - ({predicted(p)}), 2)) / (count(*) * var_pop(y)) AS test_r2,
            avg(abs(y - ({predicted(p)}))) AS test_mae, sqrt(avg(power(y - ({predicted(p)}), 2))) AS test_rmse
            FROM prepped JOIN chosen c USING (seed) JOIN fits f ON f.seed = c.seed AND f.cell = c.cell AND f.held = -1
            WHERE part = -1 GROUP BY c.seed, c.learner, c.alpha)""",
    ]


def run_table(spark, sf_dir, seeds, grid):
    rows = clipped(spark, sf_dir, [KEY, *FEATURES])
    best = best_cells(gram_runs(rows, FEATURES, LABEL, KEY, seeds, grid))
    return with_test_mae(best, rows, FEATURES, LABEL, KEY, seeds)


OLS_RUNS = [*BASE[:3], *runs_sql(RUN_SEEDS, {"ols": [0.0]})]


@query(
    "run_summary",
    with_(
        *OLS_RUNS,
        select=" UNION ALL ".join(
            f"SELECT learner, '{s}' AS statistic, " + ", ".join(f"{r(f'{fn}({m})')} AS {m}" for m in runs.METRICS) + " FROM run_table GROUP BY learner"
            for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
        ),
    ),
)
def run_summary(spark, sf_dir):
    summary = runs.run_summary(run_table(spark, sf_dir, RUN_SEEDS, {"ols": [0.0]}), model="learner")
    return summary.select("learner", "statistic", *[rounded(m).alias(m) for m in runs.METRICS])


@query(
    "closest_to_mean_run",
    with_(
        *OLS_RUNS,
        select=f"""SELECT learner, seed::int AS seed, {r('test_r2')} AS test_r2, {r('cv_r2')} AS cv_r2 FROM run_table
        QUALIFY row_number() OVER (PARTITION BY learner ORDER BY abs(test_r2 - (SELECT avg(test_r2) FROM run_table)), seed) = 1""",
    ),
)
def closest_to_mean_run(spark, sf_dir):
    rows = clipped(spark, sf_dir, [KEY, *FEATURES])
    table = best_cells(gram_runs(rows, FEATURES, LABEL, KEY, RUN_SEEDS, {"ols": [0.0]}))
    chosen = runs.closest_to_mean_run(table, model="learner")
    return chosen.select("learner", "seed", rounded("test_r2").alias("test_r2"), rounded("cv_r2").alias("cv_r2"))


def r2_rows(feature_list=ALL_FEATURES) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, regr_r2(y, {f}) AS importance FROM clipped" for f in feature_list)


@query(
    "normalise_share",
    with_(
        *BASE[:3],
        f"importance AS ({r2_rows()})",
        select=f"SELECT feature, {r('importance', 9)} AS importance, {r('importance / (SELECT sum(importance) FROM importance)')} AS share FROM importance",
    ),
)
def normalise_share(spark, sf_dir):
    from ..operators.select import univariate_importance

    imp = univariate_importance(clipped(spark, sf_dir, ALL_FEATURES), ALL_FEATURES, LABEL)
    return reshape.normalise_share(imp, "importance").select(
        "feature", rounded("importance", 9).alias("importance"), rounded("share").alias("share")
    )


@query(
    "t_confidence_interval",
    with_(
        OBS,
        "folds AS (SELECT place, x_size::bigint % 5 AS fold, avg(y) AS v FROM obs GROUP BY ALL)",
        "s AS (SELECT place, avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS sem FROM folds GROUP BY place)",
        select=f"""SELECT place, {r('m')} AS mean, {r('m - 2.7764451051977987::double * sem')} AS ci_low,
        {r('m + 2.7764451051977987::double * sem')} AS ci_high FROM s""",
    ),
)
def t_confidence_interval(spark, sf_dir):
    obs = observations(spark, sf_dir, ["place", "x_size", LABEL])
    folds = obs.groupBy("place", (F.col("x_size").cast("bigint") % 5).alias("fold")).agg(F.avg(LABEL).alias("v"))
    ci = reshape.t_confidence_interval(folds, ["place"], "v")
    return ci.select("place", *[rounded(c).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query(
    "pivot_wide",
    with_(
        OBS,
        "cells AS (SELECT place, scenario, avg(y) AS v FROM obs GROUP BY ALL)",
        select="SELECT place, " + ", ".join(f"{r(f'''max(v) FILTER (scenario = '{s}')''')} AS {s}" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
        + " FROM cells GROUP BY place",
    ),
)
def pivot_wide(spark, sf_dir):
    from .common import SCENARIOS

    cells = observations(spark, sf_dir, ["place", "scenario", LABEL]).groupBy("place", "scenario").agg(rounded(F.avg(LABEL)).alias("v"))
    return reshape.pivot_wide(cells.where(F.col("scenario").isin(SCENARIOS)), ["place"], "scenario", "v", SCENARIOS)


@query(
    "interval_summary",
    with_(
        OBS,
        select="SELECT scenario, "
        + ", ".join(
            f"{r(f'quantile_cont({c}, {q})')} AS {c}_{n}"
            for c in ("y", "x_total")
            for n, q in (("median", 0.5), ("lower", 0.025), ("upper", 0.975))
        )
        + " FROM obs GROUP BY scenario",
    ),
)
def interval_summary(spark, sf_dir):
    s = reshape.interval_summary(observations(spark, sf_dir, ["scenario", LABEL, "x_total"]), ["scenario"], [LABEL, "x_total"])
    return s.select("scenario", *[rounded(c).alias(c) for c in s.columns if c != "scenario"])


@query(
    "probability_of",
    with_(OBS, select=f"SELECT scenario, {r('avg(CASE WHEN y > 4 THEN 1.0::double ELSE 0 END)')} AS p FROM obs GROUP BY scenario"),
)
def probability_of(spark, sf_dir):
    obs = observations(spark, sf_dir, ["scenario", LABEL])
    return obs.groupBy("scenario").agg(rounded(reshape.probability_of(F.col(LABEL) > 4)).alias("p"))


@query(
    "assumption_table",
    with_(
        *BASE,
        select="""SELECT 'observations' AS item, count(*)::varchar AS value FROM obs
        UNION ALL SELECT 'clipped_rows', count(*)::varchar FROM clipped
        UNION ALL SELECT 'test_rows', count(*)::varchar FROM split WHERE is_test
        UNION ALL SELECT 'simulations', '10000' UNION ALL SELECT 'gwp_ch4', '28' UNION ALL SELECT 'gwp_n2o', '273'
        UNION ALL SELECT 'default_hlr', '0.2' UNION ALL SELECT 'water_volume', '67828164300'""",
    ),
)
def assumption_table(spark, sf_dir):
    from ..functions.hashing import below, seed_hex
    from ..operators.clean import quantile_bounds

    obs = observations(spark, sf_dir, [KEY, LABEL])
    b = quantile_bounds(obs, LABEL)
    kept = F.col(LABEL).between(b.low, b.high)
    return reshape.assumption_table(
        obs,
        [
            ("observations", F.count(F.lit(1))),
            ("clipped_rows", F.count_if(kept)),
            ("test_rows", F.count_if(kept & below(seed_hex(0, KEY), study.TEST_FRACTION))),
            ("simulations", F.lit(study.N_SIMULATIONS)),
            ("gwp_ch4", F.lit(int(study.GWP_CH4))),
            ("gwp_n2o", F.lit(int(study.GWP_N2O))),
            ("default_hlr", F.lit(study.DEFAULT_HLR_M3_M2_D)),
            ("water_volume", F.lit(int(study.WATER_VOLUME_M3_PER_YEAR))),
        ],
    )


BY_PLACE = "by_place AS (SELECT place, avg(y) AS v FROM obs GROUP BY place)"


def place_means(spark, sf_dir):
    return observations(spark, sf_dir, ["place", LABEL]).groupBy("place").agg(rounded(F.avg(LABEL), 9).alias("v"))


@query(
    "rank_desc",
    with_(OBS, BY_PLACE, select=f"SELECT row_number() OVER (ORDER BY round(v, 9) DESC, place) AS rank, place, {r('v')} AS v FROM by_place"),
)
def rank_desc(spark, sf_dir):
    return reshape.rank_desc(place_means(spark, sf_dir), "v", "place").withColumn("v", rounded("v"))


@query(
    "rank_all_rows",
    with_(OBS, select="SELECT obs_key, tiebreak, row_number() OVER (ORDER BY x_size DESC, obs_key, tiebreak) AS rank FROM obs"),
)
def rank_all_rows(spark, sf_dir):
    """The whole table ranked by a heavily tied value, by range partitions and offsets."""
    from ..functions.order_stats import value_order_rank

    obs = observations(spark, sf_dir, [KEY, TIEBREAK, "x_size"])
    return value_order_rank(obs, [F.desc("x_size"), F.asc(KEY), F.asc(TIEBREAK)]).drop("x_size")


@query(
    "head_tail_k",
    with_(
        OBS,
        select=f"""(SELECT obs_key, {r('y')} AS y, 'head' AS side FROM obs ORDER BY round(obs.y, 9) DESC, obs_key LIMIT 10)
        UNION ALL (SELECT obs_key, {r('y')} AS y, 'tail' AS side FROM obs ORDER BY round(obs.y, 9), obs_key DESC LIMIT 10)""",
    ),
)
def head_tail_k(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, LABEL]).withColumn(LABEL, rounded(LABEL, 9))
    return reshape.head_tail_k(obs, LABEL, KEY).withColumn(LABEL, rounded(LABEL))


@query(
    "top_k_features",
    with_(
        *BASE[:3],
        f"importance AS ({r2_rows()})",
        select=f"SELECT feature, {r('importance', 9)} AS importance FROM importance ORDER BY importance DESC, feature LIMIT 5",
    ),
)
def top_k_features(spark, sf_dir):
    from ..operators.select import univariate_importance

    imp = univariate_importance(clipped(spark, sf_dir, ALL_FEATURES), ALL_FEATURES, LABEL)
    return reshape.top_k_features(imp, "importance", 5).withColumn("importance", rounded("importance", 9))


@query(
    "growing_prefix",
    with_(
        *BASE[:3],
        f"importance AS ({r2_rows()})",
        "ranked AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM importance)",
        select="SELECT rank, feature, string_agg(feature, ',') OVER (ORDER BY rank) AS prefix FROM ranked",
    ),
)
def growing_prefix(spark, sf_dir):
    from ..operators.select import univariate_importance

    imp = univariate_importance(clipped(spark, sf_dir, ALL_FEATURES), ALL_FEATURES, LABEL)
    grown = reshape.growing_prefix(reshape.rank_desc(imp, "importance", "feature"))
    return grown.select("rank", "feature", F.concat_ws(",", "prefix").alias("prefix"))


@query(
    "ascending_for_chart",
    with_(OBS, BY_PLACE, select=f"SELECT row_number() OVER (ORDER BY round(v, 9), place) AS rank, place, {r('v')} AS v FROM by_place"),
)
def ascending_for_chart(spark, sf_dir):
    return reshape.rank_desc(place_means(spark, sf_dir), "v", "place", descending=False).withColumn("v", rounded("v"))
