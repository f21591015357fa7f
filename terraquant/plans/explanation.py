"""Feature selection, attribution and presentation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import flagged, rounded
from ..operators import clean, explain, reshape, scenario, select, split
from ..sources import study
from ..sources.tables import ALL_FEATURES, FEATURES, KEY, LABEL, TIEBREAK, observations
from .common import clipped, fitted, scored, split_rows
from .oracle import BASE, FITTED, OBS, SCORED, bits, prep, r, with_
from .registry import query
from .summaries import r2_rows

SELECTION = list(ALL_FEATURES)
SHAP = ", ".join(f"b{i} * (z{i} - (m_{f} - lo_{f}) / (hi_{f} - lo_{f})) AS shap_{f}" for i, f in enumerate(FEATURES, 1))
EXPLAINED = [*SCORED, f"explained AS (SELECT scored.*, {SHAP} FROM scored CROSS JOIN coef CROSS JOIN prepped_stats)"]
LONG = "attributions AS (" + " UNION ALL ".join(
    f"SELECT obs_key, tiebreak, '{f}' AS feature, z{i} AS value, shap_{f} AS shap FROM explained" for i, f in enumerate(FEATURES, 1)
) + ")"


def importance_sql(src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, regr_r2(y, {f}) AS importance FROM {src}" for f in SELECTION)


def selection_sql(folds: int = 5) -> list[str]:
    """Prefix scores in SQL: the Gram matrix laid out by feature rank, swept one feature at a time per left-out fold."""
    p = len(SELECTION)
    sorted_z = [f"r{k}" for k in range(1, p + 1)]
    by_rank = ", ".join(
        "CASE (SELECT feature FROM ranked WHERE rank = " + str(k) + ") "
        + " ".join(f"WHEN '{f}' THEN z{i}" for i, f in enumerate(SELECTION, 1)) + f" END AS r{k}"
        for k in range(1, p + 1)
    )
    from .oracle import gram, sweep

    parts = [
        f"train AS (SELECT *, {bits(repr('fold42'))} % {folds} AS fold FROM split WHERE NOT is_test)",
        f"importance AS ({importance_sql('train')})",
        "ranked AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM importance)",
        prep(SELECTION, "train", "true"),
        f"sorted_rows AS (SELECT fold, y, {by_rank} FROM prepped)",
        f"left_out AS (SELECT range AS held FROM range({folds}))",
        gram(sorted_z, "y", "(SELECT * FROM sorted_rows, left_out WHERE fold <> held)", by=["held"], name="g"),
        sweep(p, "g", ["held"], name="q"),
    ]
    scores = []
    for k in range(1, p + 1):
        b0 = f"m{p + 1} - " + " - ".join(f"a{i}_{p + 1} * m{i}" for i in range(1, k + 1))
        fit = f"({b0}) + " + " + ".join(f"a{i}_{p + 1} * r{i}" for i in range(1, k + 1))
        scores.append(
            f"SELECT {k} AS rank, held, 1 - sum(power(y - ({fit}), 2)) / (count(*) * var_pop(y)) AS r2 "
            f"FROM sorted_rows JOIN q{k} ON fold = held GROUP BY held"
        )
    parts.append("fold_scores AS (" + " UNION ALL ".join(scores) + ")")
    parts.append(
        """curve AS (SELECT rank, any_value(feature) AS feature, any_value(importance / (SELECT sum(importance) FROM ranked)) AS share,
        avg(r2) AS mean_r2, avg(r2) - 2.7764451051977987::double * stddev_samp(r2) / sqrt(5) AS ci_low,
        avg(r2) + 2.7764451051977987::double * stddev_samp(r2) / sqrt(5) AS ci_high
        FROM fold_scores JOIN ranked USING (rank) GROUP BY rank)"""
    )
    return parts


def selection_curve(spark, sf_dir):
    train = split_rows(spark, sf_dir, features=SELECTION).where(~F.col("is_test"))
    train = split.kfold_shuffled(train, 5, 42, KEY)
    return select.forward_prefix_cv(train, SELECTION, LABEL, "fold", top=study.SELECTION_TOP)


CURVE_SQL = [*BASE, *selection_sql()]
CURVE_COLUMNS = f"rank, feature, {r('share')} AS share, {r('mean_r2')} AS mean_r2, {r('ci_low')} AS ci_low, {r('ci_high')} AS ci_high"


def _rounded_curve(curve):
    return curve.select("rank", "feature", *[rounded(c).alias(c) for c in ("share", "mean_r2", "ci_low", "ci_high")])


@query(
    "feature_importance_univariate",
    with_(*BASE[:3], f"importance AS ({r2_rows()})", select=f"SELECT feature, {r('importance', 9)} AS importance FROM importance"),
)
def feature_importance_univariate(spark, sf_dir):
    imp = select.univariate_importance(clipped(spark, sf_dir, ALL_FEATURES), ALL_FEATURES, LABEL)
    return imp.withColumn("importance", rounded("importance", 9))


@query("forward_prefix_cv", with_(*CURVE_SQL, select=f"SELECT {CURVE_COLUMNS} FROM curve"))
def forward_prefix_cv(spark, sf_dir):
    return _rounded_curve(selection_curve(spark, sf_dir))


@query("choose_prefix", with_(*CURVE_SQL, select=f"SELECT {CURVE_COLUMNS} FROM curve WHERE rank <= 3"))
def choose_prefix(spark, sf_dir):
    return _rounded_curve(select.choose_prefix(selection_curve(spark, sf_dir), 3))


@query(
    "selection_curve_table",
    with_(*CURVE_SQL, select=f"SELECT {CURVE_COLUMNS}, rank <= 2 AS selected FROM curve"),
)
def selection_curve_table(spark, sf_dir):
    from ..operators.present import selection_curve_table as table

    curve = table(selection_curve(spark, sf_dir), 2)
    return curve.select(
        "rank", "feature", *[rounded(c).alias(c) for c in ("share", "mean_r2", "ci_low", "ci_high")], "selected"
    )


@query(
    "shap_linear",
    with_(*EXPLAINED, LONG, select=f"SELECT obs_key, tiebreak, feature, {r('value', 4)} AS value, {r('shap', 4)} AS shap FROM attributions"),
)
def shap_linear(spark, sf_dir):
    rows, model = fitted(spark, sf_dir)
    long = explain.shap_long(rows, model, [KEY, TIEBREAK])
    return long.withColumns({c: rounded(c, 4) for c in ("value", "shap")})


def explained(spark, sf_dir, extra=()):
    rows, model = scored(spark, sf_dir, extra)
    return explain.shap_wide(rows, model), model


@query(
    "shap_global_importance",
    with_(*EXPLAINED, LONG, select=f"SELECT feature, {r('avg(abs(shap))')} AS mean_abs_shap FROM attributions GROUP BY feature"),
)
def shap_global_importance(spark, sf_dir):
    wide, _ = explained(spark, sf_dir)
    return explain.global_importance(wide, FEATURES).withColumn("mean_abs_shap", rounded("mean_abs_shap"))


@query(
    "shap_dispersion",
    with_(*EXPLAINED, LONG, select=f"SELECT feature, {r('stddev_pop(shap)')} AS shap_std FROM attributions GROUP BY feature"),
)
def shap_dispersion(spark, sf_dir):
    wide, _ = explained(spark, sf_dir)
    return explain.dispersion(wide, FEATURES).withColumn("shap_std", rounded("shap_std"))


@query(
    "shap_wide_export",
    with_(
        *EXPLAINED,
        select=f"SELECT obs_key, tiebreak, {r('y', 4)} AS observed, {r('prediction', 4)} AS prediction, "
        + ", ".join(f"{r(f'shap_{f}', 4)} AS shap_{f}" for f in FEATURES) + " FROM explained",
    ),
)
def shap_wide_export(spark, sf_dir):
    wide, _ = explained(spark, sf_dir)
    return wide.select(
        KEY, TIEBREAK, rounded(LABEL, 4).alias("observed"), rounded("prediction", 4).alias("prediction"),
        *[rounded(f"shap_{f}", 4).alias(f"shap_{f}") for f in FEATURES],
    )


@query(
    "dependence_table",
    with_(
        *EXPLAINED,
        LONG,
        "top AS (SELECT feature FROM attributions GROUP BY feature ORDER BY avg(abs(shap)) DESC, feature LIMIT 2)",
        select=f"SELECT obs_key, tiebreak, feature, {r('value', 4)} AS value, {r('shap', 4)} AS shap FROM attributions WHERE feature IN (SELECT feature FROM top)",
    ),
)
def dependence_table(spark, sf_dir):
    wide, model = explained(spark, sf_dir)
    long = explain.shap_long(wide, model, [KEY, TIEBREAK])
    top = explain.dependence_table(long, explain.global_importance(wide, FEATURES), 2)
    return top.select(KEY, TIEBREAK, "feature", rounded("value", 4).alias("value"), rounded("shap", 4).alias("shap"))


@query(
    "map_table",
    with_(
        OBS,
        "v AS (SELECT place, avg(y) AS y, avg(x_total) AS x_total FROM obs GROUP BY place)",
        "long AS (SELECT place, 'y' AS variable, y AS value FROM v UNION ALL SELECT place, 'x_total', x_total FROM v)",
        select=f"""SELECT variable, CASE place WHEN 'NATION_1' THEN 'Beijing' WHEN 'NATION_2' THEN 'Tianjin' ELSE place END AS label, {r('value')} AS value,
        {r('min(value) OVER (PARTITION BY variable)')} AS low, {r('max(value) OVER (PARTITION BY variable)')} AS high FROM long""",
    ),
)
def map_table(spark, sf_dir):
    """One map table per variable; two places carry names the lookup translates."""
    from ..operators.present import map_table as table

    obs = observations(spark, sf_dir, ["place", LABEL, "x_total"])
    named = F.when(F.col("place") == "NATION_1", F.lit(" 北京 ")).when(F.col("place") == "NATION_2", F.lit("天津市")).otherwise(F.col("place"))
    values = obs.groupBy(named.alias("place")).agg(F.avg(LABEL).alias(LABEL), F.avg("x_total").alias("x_total"))
    tables = [table(values, "place", v).withColumn("variable", F.lit(v)) for v in (LABEL, "x_total")]
    return tables[0].unionByName(tables[1]).withColumns({c: rounded(c) for c in ("value", "low", "high")})


@query(
    "ranking_bar_table",
    with_(
        OBS,
        "v AS (SELECT place, round(avg(y), 9) AS v FROM obs GROUP BY place)",
        select=f"""SELECT row_number() OVER (ORDER BY v, place) AS position, place AS label, {r('v')} AS value,
        {r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())')} AS share FROM v""",
    ),
)
def ranking_bar_table(spark, sf_dir):
    from ..operators.present import ranking_bar_table as table

    values = observations(spark, sf_dir, ["place", LABEL]).groupBy("place").agg(F.round(F.avg(LABEL), 9).alias("v"))
    return table(values, "place", "v").withColumns({c: rounded(c) for c in ("value", "share")})


@query(
    "driver_bar_table",
    with_(
        *EXPLAINED,
        LONG,
        "d AS (SELECT feature, stddev_pop(shap) AS shap_std FROM attributions GROUP BY feature)",
        select=f"SELECT row_number() OVER (ORDER BY shap_std, feature) AS position, feature, {r('shap_std')} AS shap_std, feature IN ('x_qty', 'x_tax') AS focus FROM d",
    ),
)
def driver_bar_table(spark, sf_dir):
    from ..operators.present import driver_bar_table as table

    wide, _ = explained(spark, sf_dir)
    return table(explain.dispersion(wide, FEATURES), ["x_qty", "x_tax"]).withColumn("shap_std", rounded("shap_std"))


@query(
    "prediction_scatter_table",
    with_(
        *SCORED,
        "span AS (SELECT least(min(y), min(prediction)) AS lo, greatest(max(y), max(prediction)) AS hi FROM scored)",
        select=f"""SELECT obs_key, tiebreak, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, {r('y', 4)} AS observed, {r('prediction', 4)} AS predicted,
        {r('lo - 0.05 * (hi - lo)')} AS axis_min, {r('hi + 0.05 * (hi - lo)')} AS axis_max FROM scored CROSS JOIN span""",
    ),
)
def prediction_scatter_table(spark, sf_dir):
    from ..operators.present import prediction_scatter_table as table

    rows, _ = scored(spark, sf_dir)
    scatter = table(rows, [KEY, TIEBREAK], LABEL)
    return scatter.withColumns({"observed": rounded("observed", 4), "predicted": rounded("predicted", 4), "axis_min": rounded("axis_min"), "axis_max": rounded("axis_max")})
