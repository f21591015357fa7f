"""Trees over seeds, folds and grids, forests, drawn thresholds, leaf-wise and symmetric boosting: queries beside their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import attribution, forests, growth, reshape, runs, search, select
from ..operators.splits import Growth
from ..sources import study
from ..sources.tables import ALL_FEATURES, FEATURES, KEY, LABEL
from .common import clipped
from .oracle import BOUNDS, CLIPPED, OBS, draw, is_test, prep, r, with_
from .registry import query

SEEDS, FOLDS = 50, 5
DEPTHS, LEAST = [1, 2, 3, 4], [1, 1500, 4000]
GRID_FEATURES = FEATURES[:2]
TREES, FOREST_DEPTH, PER_NODE = 20, 4, 2


def _long(src: str, keys: str, p: int, where: str = "w > 0") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, node, {i} AS f, z{i} AS v, w, w * t AS wt FROM {src} WHERE {where}" for i in range(1, p + 1))


def _value(p: int) -> str:
    return "CASE b.f " + " ".join(f"WHEN {i} THEN z{i}" for i in range(1, p + 1)) + " END"


def level_sql(name: str, src: str, keys: Sequence[str], p: int, least: str = "1", l2: float = 0.0, rule: str = "best", among: str = "true") -> list[str]:
    """One level of growth: ``{name}`` is ``src`` with its rows one node down.

    ``src`` has keys, node, w, t (target) and z1..zp. ``rule``: best cut of each node, the common cut of a
    level, or the best cut of all nodes alone; ``among`` restricts (node, f).
    """
    k = ", ".join(keys)
    score = lambda s, n: f"{s} * {s} / ({n} + {l2}::double)"
    gain = f"{score('sl', 'nl')} + {score('(st - sl)', '(nt - nl)')} - {score('st', 'nt')}"
    one = f"QUALIFY row_number() OVER (PARTITION BY {k}, node ORDER BY gain DESC, f, v) = 1"
    out = [
        f"{name}_sums AS (SELECT {k}, node, f, v, sum(w)::double AS n, sum(wt) AS s FROM ({_long(src, k, p)}) GROUP BY {k}, node, f, v)",
    ]
    if rule == "common":
        out += [
            f"{name}_at AS (SELECT * FROM (SELECT DISTINCT {k}, node FROM {name}_sums) JOIN (SELECT DISTINCT {k}, f, v FROM {name}_sums) USING ({k}))",
            f"""{name}_cuts AS (SELECT a.*, sum(coalesce(n, 0)) OVER upto AS nl, sum(coalesce(s, 0)) OVER upto AS sl, sum(coalesce(n, 0)) OVER whole AS nt,
                sum(coalesce(s, 0)) OVER whole AS st FROM {name}_at a LEFT JOIN {name}_sums USING ({k}, node, f, v)
                WINDOW upto AS (PARTITION BY {k}, node, f ORDER BY v), whole AS (PARTITION BY {k}, node, f))""",
            f"""{name}_level AS (SELECT {k}, f, v, sum({gain}) AS gain FROM {name}_cuts WHERE nl >= {least} AND nt - nl >= {least} GROUP BY {k}, f, v
                QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY gain DESC, f, v) = 1)""",
            f"{name}_best AS (SELECT DISTINCT {k}, node, l.f, l.v FROM {name}_sums JOIN {name}_level l USING ({k}))",
        ]
    else:
        out += [
            f"""{name}_cuts AS (SELECT *, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl, sum(n) OVER whole AS nt, sum(s) OVER whole AS st
                FROM {name}_sums WINDOW upto AS (PARTITION BY {k}, node, f ORDER BY v), whole AS (PARTITION BY {k}, node, f))""",
            f"""{name}_found AS (SELECT {k}, node, f, v, {gain} AS gain FROM {name}_cuts WHERE nl >= {least} AND nt - nl >= {least} AND {among} {one})""",
            f"{name}_best AS (SELECT * FROM {name}_found WHERE gain > 0"
            + (f" QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY gain DESC, node) = 1)" if rule == "single" else ")"),
        ]
    same = " AND ".join(f"b.{x} = s.{x}" for x in keys)
    stay = "s.node" if rule == "single" else "2 * s.node"
    move = f"CASE WHEN b.f IS NULL THEN {stay} ELSE 2 * s.node + ({_value(p)} > b.v)::int END"
    out.append(f"{name} AS (SELECT s.* REPLACE ({move} AS node) FROM {src} s LEFT JOIN {name}_best b ON {same} AND b.node = s.node)")
    return out


def values_sql(name: str, src: str, keys: Sequence[str], l2: float = 0.0) -> str:
    """Node values of the training rows beside every row."""
    k = ", ".join(keys)
    return (
        f"{name} AS (SELECT s.*, value FROM {src} s JOIN (SELECT {k}, node, sum(w * t) / (sum(w) + {l2}::double) AS value FROM {src} "
        f"WHERE w > 0 GROUP BY {k}, node) USING ({k}, node))"
    )


def _grid_sql() -> str:
    """Cells of equal features are one row with counts and sums, since no metric here needs single rows."""
    test, p = is_test("seed"), len(GRID_FEATURES)
    keys = ["seed", "held", "m"]
    zs = ", ".join(f"z{i}" for i in range(1, p + 1))
    ctes = [
        OBS, BOUNDS, CLIPPED,
        f"""seeded AS (SELECT {', '.join(GRID_FEATURES)}, y, seed, {test} AS is_test, CASE WHEN {test} THEN -1 ELSE {draw('seed')} % {FOLDS} END AS part
            FROM clipped CROSS JOIN (SELECT range AS seed FROM range({SEEDS})))""",
        prep(GRID_FEATURES, "seeded", scale=False, by="seed"),
        f"cells AS (SELECT seed, part, {zs}, count(*)::double AS n, sum(y) AS s, sum(y * y) AS q FROM prepped GROUP BY ALL)",
        f"""l0 AS (SELECT seed, held, m, {zs}, n, s, q, part = held AS told, CASE WHEN part <> -1 AND part <> held THEN n ELSE 0 END AS w, s / n AS t, 1::bigint AS node
            FROM cells CROSS JOIN (SELECT range - 1 AS held FROM range({FOLDS + 1})) CROSS JOIN (SELECT unnest({LEAST}) AS m) WHERE part <> -1 OR held = -1)""",
    ]
    scored = []
    for d in range(1, max(DEPTHS) + 1):
        ctes += level_sql(f"l{d}", f"l{d - 1}", keys, p, least="m")
        ctes.append(values_sql(f"v{d}", f"l{d}", keys))
        scored.append(
            f"SELECT seed, held, m, {d} AS depth, 1 - sum(q - 2 * value * s + value * value * n) / (sum(q) - sum(s) * sum(s) / sum(n)) AS r2 FROM v{d} WHERE told GROUP BY ALL"
        )
    ctes.append(f"scored AS ({' UNION ALL '.join(scored)})")
    ctes.append(
        f"""mean AS (SELECT seed, m, depth, {len(LEAST)} * list_position({DEPTHS}, depth) + list_position({LEAST}, m) - {len(LEAST)} - 1 AS cell, round(avg(r2), 9) AS cv_r2
            FROM scored WHERE held >= 0 GROUP BY ALL)"""
    )
    ctes.append("first AS (SELECT * FROM mean QUALIFY row_number() OVER (PARTITION BY seed ORDER BY cv_r2 DESC, cell) = 1)")
    return with_(
        *ctes,
        select=f"""SELECT cell::int AS cell, depth::int AS max_depth, m::int AS min_leaf, {r('avg(mean.cv_r2)')} AS cv_r2, count(first.seed) AS chosen,
        {r('coalesce(avg(scored.r2) FILTER (first.seed IS NOT NULL), 0)')} AS test_r2
        FROM mean LEFT JOIN first USING (seed, m, depth, cell) JOIN scored USING (seed, m, depth) WHERE scored.held = -1 GROUP BY ALL""",
    )


@query("grid_search_trees", _grid_sql())
def grid_search_trees(spark, sf_dir):
    """50 seeds, 5 folds and their refits of 12 cells: mean fold R2, how many seeds choose the cell, their mean test R2."""
    rows = forests.replicated_rows(clipped(spark, sf_dir, [KEY, *GRID_FEATURES]), GRID_FEATURES, LABEL, KEY, SEEDS, FOLDS)
    grid = {"max_depth": DEPTHS, "min_leaf": LEAST}
    cells = growth.grid_cells(grid)
    models = forests.grid_models(rows, range(SEEDS), grid)
    table = forests.cell_table(rows, models)
    names = spark.createDataFrame([(i, c["max_depth"], c["min_leaf"]) for i, c in enumerate(cells)], "cell int, max_depth int, min_leaf int")
    return names.join(table, "cell").select("cell", "max_depth", "min_leaf", rounded("cv_r2").alias("cv_r2"), "chosen", rounded("test_r2").alias("test_r2"))


def _prepared(seed: int = 0) -> list[str]:
    return [OBS, BOUNDS, CLIPPED, f"split AS (SELECT *, {is_test(seed)} AS is_test FROM clipped)", prep(scale=False)]


_ZS = ", ".join(f"z{i}" for i in range(1, len(FEATURES) + 1))
_METRICS = f"""count(*) AS n, {r('1 - sum(power(y - p, 2)) / (count(*) * var_pop(y))', 5)} AS r2, {r('avg(abs(y - p))', 5)} AS mae,
    {r('sqrt(avg(power(y - p, 2)))', 5)} AS rmse"""


def _tree_bits(tag: str) -> str:
    """First 32 bits of the md5 of a tree's name, its node and a feature counted from 0."""
    return f"('0x' || substr(md5(concat('{tag}:0:-1:', tree, ':', node, ':', f - 1)), 1, 8))::bigint"


def _forest_sql(bootstrap: bool, drawn: bool) -> str:
    p, keys = len(FEATURES), ["tree"]
    u = f"('0x' || substr(md5(concat('tree', tree // 4, ':', obs_key)), 1 + 8 * (tree % 4), 8))::bigint / 4294967296.0::double"
    weight = "(" + " + ".join(f"({u} >= {c!r}::double)::int" for c in map(float, growth.POISSON)) + ")" if bootstrap else "1"
    ctes = [*_prepared(), f"""l0 AS (SELECT obs_key, tiebreak, is_test, y, y AS t, tree, {_ZS}, CASE WHEN is_test THEN 0 ELSE {weight} END AS w, 1::bigint AS node
        FROM prepped CROSS JOIN (SELECT range AS tree FROM range({TREES})))"""]
    for d in range(1, FOREST_DEPTH + 1):
        name, src = f"l{d}", f"l{d - 1}"
        picked = f"""{name}_f AS (SELECT tree, node, f FROM (SELECT DISTINCT tree, node FROM {src} WHERE w > 0) CROSS JOIN (SELECT range + 1 AS f FROM range({p}))
            QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_tree_bits('node')}, f) <= {PER_NODE})"""
        ctes.append(picked)
        if not drawn:
            ctes += level_sql(name, src, keys, p, among=f"(tree, node, f) IN (SELECT (tree, node, f) FROM {name}_f)")
            continue
        score = lambda s, n: f"{s} * {s} / {n}"
        ctes += [
            f"{name}_long AS ({_long(src, 'tree', p)})",
            f"""{name}_ends AS (SELECT tree, node, f, min(v) AS lo, max(v) AS hi, sum(w) AS nt, sum(wt) AS st FROM {name}_long JOIN {name}_f USING (tree, node, f) GROUP BY ALL)""",
            f"""{name}_cut AS (SELECT *, lo + {_tree_bits('cut')} / 4294967296.0::double * (hi - lo) AS cut FROM {name}_ends WHERE lo < hi)""",
            f"""{name}_best AS (SELECT tree, node, f, cut AS v FROM (SELECT tree, node, f, cut, nt, st, sum(w) AS nl, sum(wt) AS sl FROM {name}_long JOIN {name}_cut USING (tree, node, f)
                WHERE v <= cut GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {score('sl', 'nl')} + {score('(st - sl)', '(nt - nl)')} DESC, f) = 1)""",
            f"""{name} AS (SELECT s.* REPLACE (CASE WHEN b.f IS NULL THEN 2 * s.node ELSE 2 * s.node + ({_value(p)} > b.v)::int END AS node)
                FROM {src} s LEFT JOIN {name}_best b ON b.tree = s.tree AND b.node = s.node)""",
        ]
    ctes += [values_sql("v", f"l{FOREST_DEPTH}", keys), "told AS (SELECT y, avg(value) AS p FROM v WHERE is_test GROUP BY obs_key, tiebreak, y)"]
    return with_(*ctes, select=f"SELECT {_METRICS}, (SELECT count(DISTINCT (tree, node)) FROM l{FOREST_DEPTH} WHERE w > 0) AS leaves FROM told")


def _forest(spark, sf_dir, grown: Growth, draws: int):
    rows = forests.replicated_rows(clipped(spark, sf_dir, [KEY, *FEATURES]), FEATURES, LABEL, KEY, 1, FOLDS, draws)
    model = growth.Model(0, -1, 0, growth.grow(rows, [growth.Spec(0, -1, k, grown) for k in range(TREES)]))
    leaves = sum(f < 0 for t in model.trees for f in t.feature)
    told = growth.evaluate(rows, [model])
    return told.select("n", *[rounded(c, 5).alias(c) for c in ("r2", "mae", "rmse")], F.lit(leaves).cast("long").alias("leaves"))


@query("fit_bootstrap_forest", _forest_sql(True, False))
def fit_bootstrap_forest(spark, sf_dir):
    """20 trees on keyed bootstraps, two of three features drawn at every node: test metrics and leaves."""
    return _forest(spark, sf_dir, Growth(FOREST_DEPTH, bootstrap=True, features_per_node=PER_NODE), TREES)


@query("fit_drawn_trees", _forest_sql(False, True))
def fit_drawn_trees(spark, sf_dir):
    """20 trees whose thresholds are drawn between a node's least and greatest value: test metrics and leaves."""
    return _forest(spark, sf_dir, Growth(FOREST_DEPTH, drawn=True, features_per_node=PER_NODE), 0)


ROUNDS, RATE, MAX_LEAVES, L2 = 3, 0.3, 5, 20.0


def _boost_sql(symmetric: bool) -> str:
    keys, p = ["k"], len(FEATURES)
    ctes = [*_prepared(), f"""r0 AS (SELECT is_test, y, 0 AS k, {_ZS}, CASE WHEN is_test THEN 0 ELSE 1 END AS w, 1::bigint AS node,
        (SELECT avg(y) FROM prepped WHERE NOT is_test) AS p FROM prepped)"""]
    for i in range(ROUNDS):
        ctes.append(f"g{i}_0 AS (SELECT *, y - p AS t FROM r{i})")
        steps = 3 if symmetric else MAX_LEAVES - 1
        for d in range(1, steps + 1):
            ctes += level_sql(f"g{i}_{d}", f"g{i}_{d - 1}", keys, p, l2=L2, rule="common" if symmetric else "single")
        ctes.append(values_sql(f"v{i}", f"g{i}_{steps}", keys, L2))
        ctes.append(f"r{i + 1} AS (SELECT * EXCLUDE (t, value) REPLACE (1::bigint AS node, p + {RATE}::double * value AS p) FROM v{i})")
    return with_(*ctes, select=f"SELECT {_METRICS} FROM r{ROUNDS} WHERE is_test")


def _boosted(spark, sf_dir, grown: Growth):
    rows = forests.replicated_rows(clipped(spark, sf_dir, [KEY, *FEATURES]), FEATURES, LABEL, KEY, 1, FOLDS)
    models = growth.boost(rows, [(0, -1, None)], grown, ROUNDS, RATE)
    return growth.evaluate(rows, models).select("n", *[rounded(c, 5).alias(c) for c in ("r2", "mae", "rmse")])


@query("fit_leafwise_boosting", _boost_sql(False))
def fit_leafwise_boosting(spark, sf_dir):
    """Best-first trees of five leaves on residuals, with a penalty on leaf values."""
    return _boosted(spark, sf_dir, Growth(max_depth=30, max_leaves=MAX_LEAVES, l2=L2))


@query("fit_symmetric_boosting", _boost_sql(True))
def fit_symmetric_boosting(spark, sf_dir):
    """Trees with one split for all nodes of a level, with a penalty on leaf values."""
    return _boosted(spark, sf_dir, Growth(max_depth=3, symmetric=True, l2=L2))


IMPORTANCE_ROUNDS = 100


def _all_features(spark, sf_dir, seeds: int = 1, draws: int = 0):
    return forests.replicated_rows(clipped(spark, sf_dir, [KEY, *ALL_FEATURES]), ALL_FEATURES, LABEL, KEY, seeds, FOLDS, draws)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """How often 100 boosted trees of the training rows split on each of all eight features, ranked; unused ones have 0."""
    models = growth.boost(_all_features(spark, sf_dir), [(0, -1, None)], Growth(max_depth=2), IMPORTANCE_ROUNDS, 0.1)
    counts = growth.split_counts(growth.node_table(spark, models, ALL_FEATURES))
    every = spark.createDataFrame([(f,) for f in ALL_FEATURES], "feature string").join(counts, "feature", "left")
    splits = every.select("feature", F.coalesce("splits", F.lit(0).cast("long")).alias("importance"), rounded(F.coalesce("gain", F.lit(0.0)), 4).alias("gain"))
    return reshape.rank_desc(splits, "importance", "feature")


@query("forward_prefix_boosted")
def forward_prefix_boosted(spark, sf_dir):
    """Forward selection with a boosted learner: every prefix of the ranking and every fold grow in the same scans."""
    clip = clipped(spark, sf_dir, [KEY, *ALL_FEATURES])
    importance = select.univariate_importance(clip, ALL_FEATURES, LABEL)
    order = [r["feature"] for r in importance.orderBy(F.desc("importance"), "feature").collect()]
    rows = forests.replicated_rows(clip, order, LABEL, KEY, 1, FOLDS)
    scores = forests.prefix_scores(rows, Growth(max_depth=3), rounds=10, rate=0.3)
    curve = select.selection_curve(importance, scores)
    return curve.select("rank", "feature", *[rounded(c).alias(c) for c in ("share", "mean_r2", "ci_low", "ci_high")])


FOREST = {"trees": [5, 10], "max_depth": [4]}


@query("mean_importance")
def mean_importance(spark, sf_dir):
    """Mean share of the gain by feature of 50 bootstrap forests, one a seed, on all eight features."""
    rows = _all_features(spark, sf_dir, SEEDS, 10)
    models = forests.grid_models(rows, range(SEEDS), {"trees": [10]}, Growth(4, bootstrap=True, features_per_node=3), held=[-1])
    shares = forests.gain_shares(growth.node_table(spark, models, ALL_FEATURES), ALL_FEATURES)
    table = shares.groupBy(F.lit("random_forest").alias("model"), F.col("rep").alias("seed")).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "share"))).alias("importance")
    )
    return runs.mean_importance(table).withColumn("mean_importance", rounded("mean_importance", 4))


@query("compare_all_models")
def compare_all_models(spark, sf_dir):
    """Leaderboard over 50 seeds and 5 folds of the linear learners, trees, both forests and boosting; neighbours on one seed and two folds."""
    clip = clipped(spark, sf_dir, [KEY, *FEATURES])
    linear = {"ols": [0.0], "ridge": study.GRIDS["ridge"]["alpha"], "lasso": study.GRIDS["lasso"]["alpha"]}
    union = search.linear_run_table(clip, FEATURES, LABEL, KEY, SEEDS, linear)
    rows = forests.replicated_rows(clip, FEATURES, LABEL, KEY, SEEDS, FOLDS, 10)
    grids = {
        "decision_tree": ({"max_depth": [4, 6], "min_leaf": [1, 5]}, Growth()),
        "random_forest": (FOREST, Growth(bootstrap=True, features_per_node=2)),
        "extra_trees": (FOREST, Growth(drawn=True, features_per_node=2)),
    }
    tables = [
        forests.run_table(rows, forests.grid_models(rows, range(SEEDS), grid, base), name, growth.grid_cells(grid)) for name, (grid, base) in grids.items()
    ]
    boosted = growth.boost(rows, [(s, h, None) for s in range(SEEDS) for h in range(-1, FOLDS)], Growth(max_depth=3), 5, 0.3)
    tables.append(forests.run_table(rows, boosted, "gbt", [{"rounds": 5, "rate": 0.3, "max_depth": 3}]))
    tables.append(search.knn_run_table(clip, FEATURES, LABEL, KEY, [0], {"k": [5, 9], "weights": ["distance"], "p": [2]}, folds=2))
    for t in tables:
        union = union.drop("importance").unionByName(t.drop("importance"))
    board = runs.compare_models(union)
    return board.withColumns({c: rounded(c, 4) for c in ("mean_r2", "std_r2", "mean_mae", "mean_rmse")})


@query("shap_trees")
def shap_trees(spark, sf_dir):
    """Exact attribution of every clipped row under a bootstrap forest: sums checked, mean absolute value by feature."""
    clip = clipped(spark, sf_dir, [KEY, *FEATURES])
    rows = forests.replicated_rows(clip, FEATURES, LABEL, KEY, 1, FOLDS, 10)
    grown = Growth(4, bootstrap=True, features_per_node=2)
    model = growth.Model(0, -1, 0, growth.grow(rows, [growth.Spec(0, -1, k, grown) for k in range(10)]))
    values = attribution.attribute(rows, model, KEY, clip)
    total = sum((F.col(f"shap_{f}") for f in FEATURES), F.col("base"))
    return values.agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(F.abs(F.col("prediction") - total)) < 1e-9).alias("efficient"),
        rounded(F.avg("prediction"), 4).alias("mean_prediction"),
        *[rounded(F.avg(F.abs(F.col(f"shap_{f}"))), 4).alias(f"mean_abs_{f}") for f in FEATURES],
    )
