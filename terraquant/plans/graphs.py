"""Graph tables, adjusted effects, refutation and falsification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import effects, falsify, graph
from ..sources import study
from ..sources.tables import ALL_FEATURES, KEY, LABEL, observations
from .common import OBS_GRAPH
from .oracle import OBS, draw, gram, prep, r, sweep, coefficients, with_
from .registry import query

# Observation columns standing in for the study's graph nodes.
STAND_IN = {
    "COD_in": "x_total", "TN_in": "x_qty", "HRT": "x_disc", "Depth": "x_size", "NH4_in": "x_price", "CN_in": "x_tax",
    "NH4_re": "x_cust", "TN_re": "x_supp", "Water_Temperature": "x_cust", "HLR": "x_supp", "CH4": "y", "N2O": "y",
}
GRAPHS = {name: [(STAND_IN[s], STAND_IN[d]) for s, d in edges] for name, edges in study.GRAPHS.items()}
NODES = [*ALL_FEATURES, LABEL]
CH4_EDGES = GRAPHS["CH4_final"]
CH4_TREATMENTS = [STAND_IN[t] for t in study.TREATMENTS["CH4_final"]]

EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{s}', '{d}')" for g, e in GRAPHS.items() for s, d in e) + ") t(graph, src, dst))"
REACH = """reach AS (SELECT graph, dst AS node, src AS ancestor FROM edges
    UNION SELECT reach.graph, reach.node, e.src FROM reach JOIN edges e ON e.graph = reach.graph AND e.dst = reach.ancestor)"""
COVERAGE = "coverage AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS complete FROM obs" for a in NODES for b in NODES if a != b
) + ")"
PARENTS = """nodes AS (SELECT DISTINCT graph, unnest([src, dst]) AS node FROM edges),
    parents AS (SELECT n.graph, n.node, coalesce(string_agg(e.src, ',' ORDER BY e.src), '') AS parents
      FROM nodes n LEFT JOIN edges e ON e.graph = n.graph AND e.dst = n.node GROUP BY n.graph, n.node)"""


def _edges_and_coverage(spark, sf_dir):
    graph.validate(GRAPHS, NODES)
    return graph.edge_table(spark, GRAPHS), graph.pair_coverage(observations(spark, sf_dir, NODES), NODES)


@query("graph_edges", with_(OBS, EDGES, COVERAGE, select="SELECT graph, src, dst, complete FROM edges JOIN coverage ON a = src AND b = dst"))
def graph_edges(spark, sf_dir):
    edges, coverage = _edges_and_coverage(spark, sf_dir)
    return edges.join(coverage, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))).select("graph", "src", "dst", "complete")


@query(
    "graph_ancestors",
    with_(OBS, EDGES, REACH, COVERAGE, select="SELECT graph, node, ancestor, complete FROM reach JOIN coverage ON a = ancestor AND b = node", recursive=True),
)
def graph_ancestors(spark, sf_dir):
    edges, coverage = _edges_and_coverage(spark, sf_dir)
    reach = graph.ancestors(edges)
    return reach.join(coverage, (F.col("ancestor") == F.col("a")) & (F.col("node") == F.col("b"))).select("graph", "node", "ancestor", "complete")


@query(
    "adjustment_set",
    with_(
        OBS, EDGES, COVERAGE, PARENTS,
        select="SELECT graph, node AS treatment, parents AS adjustment, complete FROM parents JOIN coverage ON a = node AND b = 'y' WHERE node <> 'y'",
    ),
)
def adjustment_set(spark, sf_dir):
    """Backdoor sets of every node, with the rows that have both treatment and outcome."""
    edges, coverage = _edges_and_coverage(spark, sf_dir)
    treatments = graph.node_table(edges).where(F.col("node") != LABEL).withColumnRenamed("node", "treatment")
    sets = graph.adjustment_sets(edges, treatments)
    both = coverage.where(F.col("b") == LABEL).select(F.col("a").alias("treatment"), "complete")
    return sets.join(both, "treatment").select("graph", "treatment", F.concat_ws(",", "adjustment").alias("adjustment"), "complete")


@query(
    "implied_independencies",
    with_(
        OBS, EDGES, REACH, COVERAGE, PARENTS,
        """conditions AS (SELECT x.graph, x.node AS x, y.node AS y, x.parents AS given FROM parents x JOIN nodes y ON x.graph = y.graph AND x.node <> y.node
          WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.graph = x.graph AND reach.ancestor = x.node AND reach.node = y.node)
          AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = x.graph AND e.dst = x.node AND e.src = y.node))""",
        select="SELECT graph, x, y, given, complete FROM conditions JOIN coverage ON a = x AND b = y",
        recursive=True,
    ),
)
def implied_independencies(spark, sf_dir):
    edges, coverage = _edges_and_coverage(spark, sf_dir)
    conditions = graph.implied_independencies(edges)
    joined = conditions.join(coverage, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    return joined.select("graph", "x", "y", F.concat_ws(",", "given").alias("given"), "complete")


def _effect_ctes(treatment: str, given: list[str], src: str = "filled", name: str = "", by: list[str] = (), outcome: str = "y") -> list[str]:
    """Slope of a treatment: the adjustment set is swept first, so the last pivot is the treatment's own variance."""
    p = len(given) + 1
    columns = [*given, treatment]
    name = name or f"e_{treatment}"
    keep = [*by, "n"]
    parts = [gram(columns, outcome, src, by=by, name=f"{name}_g"), sweep(p, f"{name}_g", keep, name=f"{name}_s")]
    return parts


def _filled(nodes, src="obs", name="filled", scale=False) -> str:
    """Imputed columns under their own names."""
    p = prep(nodes, src, "true", scale=scale, name=f"{name}_z")
    rest = [c for c in (KEY, LABEL)]
    return p + f", {name} AS (SELECT {', '.join(rest)}, " + ", ".join(f"z{i} AS {f}" for i, f in enumerate(nodes, 1)) + f" FROM {name}_z)"


CH4_NODES = effects.graph_features(CH4_EDGES, LABEL)


def _effect_sql(edges, treatments, scale=False) -> list[str]:
    nodes = effects.graph_features(edges, LABEL)
    parts = [OBS, _filled(nodes, scale=scale)]
    rows = []
    for t in treatments:
        given = effects.adjustment(edges, t)
        p = len(given) + 1
        parts += _effect_ctes(t, given)
        pivot = f"e_{t}_s{p - 1}.a{p}_{p}" if p > 1 else f"e_{t}_g.a1_1"
        source = f"e_{t}_s{p}" + (f", e_{t}_s{p - 1}" if p > 1 else f", e_{t}_g")
        last = f"e_{t}_s{p}"
        b0 = f"{last}.m{p + 1} - " + " - ".join(f"{last}.a{i}_{p + 1} * {last}.m{i}" for i in range(1, p + 1))
        fit = f"({b0}) + " + " + ".join(f"{last}.a{i}_{p + 1} * {c}" for i, c in enumerate([*given, t], 1))
        rows.append(
            f"SELECT '{t}' AS treatment, any_value({last}.a{p}_{p + 1}) AS effect, count(*) AS n, "
            f"sqrt(sum(power(y - ({fit}), 2)) / (count(*) - {p + 1}) / any_value({pivot})) AS std_error, count(*) - {p + 1} AS df FROM filled, {source}"
        )
    z = "1.959963984540054::double"
    # Student quantile by its expansion in 1/df around the normal quantile.
    t_quantile = (
        f"({z} + (power({z}, 3) + {z}) / (4 * df) + (5 * power({z}, 5) + 16 * power({z}, 3) + 3 * {z}) / (96 * df * df))"
    )
    parts.append("effects AS (" + " UNION ALL ".join(rows) + ")")
    parts.append(
        f"report AS (SELECT *, effect / std_error AS t_stat, effect - {t_quantile} * std_error AS ci_low, effect + {t_quantile} * std_error AS ci_high FROM effects)"
    )
    return parts


EFFECT_COLUMNS = ("effect", "std_error", "ci_low", "ci_high")


def _effect_select(src="report", extra="") -> str:
    return f"SELECT treatment, n, {', '.join(f'{r(c, 9)} AS {c}' for c in EFFECT_COLUMNS)}, {r('t_stat', 4)} AS t_stat{extra} FROM {src}"


@query("backdoor_effect", with_(*_effect_sql(CH4_EDGES, CH4_TREATMENTS), select=_effect_select()))
def backdoor_effect(spark, sf_dir):
    obs = observations(spark, sf_dir, [*CH4_NODES, LABEL])
    e = effects.backdoor_effects(obs, CH4_EDGES, CH4_TREATMENTS, LABEL)
    return e.select("treatment", "n", *[rounded(c, 9).alias(c) for c in EFFECT_COLUMNS], rounded("t_stat", 4).alias("t_stat"))


N2O_EDGES = GRAPHS["N2O_final"]
N2O_TREATMENTS = [STAND_IN[t] for t in study.TREATMENTS["N2O_final"]]


@query("backdoor_effect_scaled", with_(*_effect_sql(N2O_EDGES, N2O_TREATMENTS, scale=True), select=_effect_select()))
def backdoor_effect_scaled(spark, sf_dir):
    obs = observations(spark, sf_dir, [*effects.graph_features(N2O_EDGES, LABEL), LABEL])
    e = effects.backdoor_effects(obs, N2O_EDGES, N2O_TREATMENTS, LABEL, scale=True)
    return e.select("treatment", "n", *[rounded(c, 9).alias(c) for c in EFFECT_COLUMNS], rounded("t_stat", 4).alias("t_stat"))


REPS = 100
NOISE_SQL = f"""noisy AS (SELECT filled.*, rep, {draw('rep')} / 4294967296.0::double - 0.5::double AS noise, {draw('rep')} / 4294967296.0::double < 0.8::double AS kept
    FROM filled CROSS JOIN (SELECT range AS rep FROM range({REPS})) reps)"""


def _refuter_sql(kind: str) -> list[str]:
    parts, rows = [], []
    for t in CH4_TREATMENTS:
        given = effects.adjustment(CH4_EDGES, t)
        if kind == "random_common_cause":
            parts += _effect_ctes(t, [*given, "noise"], "noisy", f"{kind}_{t}", ["rep"])
            p = len(given) + 2
        elif kind == "placebo_treatment":
            parts += _effect_ctes("noise", given, "noisy", f"{kind}_{t}", ["rep"])
            p = len(given) + 1
        else:
            parts += _effect_ctes(t, given, "(SELECT * FROM noisy WHERE kept)", f"{kind}_{t}", ["rep"])
            p = len(given) + 1
        rows.append(f"SELECT '{t}' AS treatment, rep, a{p}_{p + 1} AS effect FROM {kind}_{t}_s{p}")
    return [*parts, f"{kind} AS (" + " UNION ALL ".join(rows) + ")"]


def _refuted(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, *CH4_NODES, LABEL])
    return obs, effects.refutations(obs, CH4_EDGES, CH4_TREATMENTS, LABEL, KEY, reps=REPS)


def _register_refuter(name: str, kind: str) -> None:
    sql = with_(OBS, _filled(CH4_NODES), NOISE_SQL, *_refuter_sql(kind), select=f"SELECT treatment, rep::int AS rep, {r('effect', 9)} AS effect FROM {kind}")

    @query(name, sql)
    def refuter(spark, sf_dir):
        _, refuted = _refuted(spark, sf_dir)
        return refuted.where(F.col("refuter") == kind).select("treatment", "rep", rounded("effect", 9).alias("effect"))


_register_refuter("refute_random_cause", "random_common_cause")
_register_refuter("refute_placebo", "placebo_treatment")
_register_refuter("refute_subset", "data_subset")

KINDS = tuple(effects.REFUTERS)
REFUTER_COLUMNS = [f"{k}{end}" for k in KINDS for end in ("", "_std", "_p")]


@query(
    "effect_report",
    with_(
        *_effect_sql(CH4_EDGES, CH4_TREATMENTS),
        NOISE_SQL,
        *[c for k in KINDS for c in _refuter_sql(k)],
        *[
            f"""mean_{k} AS (SELECT treatment, avg({k}.effect) AS {k}, stddev_samp({k}.effect) AS {k}_std,
            least(1.0::double, 2 * avg(CASE WHEN {k}.effect <= {ref} THEN 1.0::double ELSE 0 END), 2 * avg(CASE WHEN {k}.effect >= {ref} THEN 1.0::double ELSE 0 END)) AS {k}_p
            FROM {k} JOIN report USING (treatment) GROUP BY treatment)"""
            for k, own in effects.REFUTERS.items()
            for ref in ("report.effect" if own else "0",)
        ],
        select=_effect_select(
            "report " + " ".join(f"JOIN mean_{k} USING (treatment)" for k in KINDS), "".join(f", {r(c, 9)} AS {c}" for c in REFUTER_COLUMNS)
        ),
    ),
)
def effect_report(spark, sf_dir):
    obs, refuted = _refuted(spark, sf_dir)
    report = effects.effect_report(effects.backdoor_effects(obs, CH4_EDGES, CH4_TREATMENTS, LABEL), refuted)
    return report.select(
        "treatment", "n", *[rounded(c, 9).alias(c) for c in EFFECT_COLUMNS], rounded("t_stat", 4).alias("t_stat"),
        *[rounded(c, 9).alias(c) for c in REFUTER_COLUMNS],
    )


GCM_TESTS = [("x_disc", "x_qty", ()), ("x_qty", "y", ()), ("x_price", "y", ("x_qty",)), ("x_size", "y", ("x_qty",))]


def _gcm_sql() -> str:
    rows = []
    for x, y, given in GCM_TESTS:
        if given:
            (z,) = given
            rx = f"{x} - regr_intercept({x}, {z}) OVER () - regr_slope({x}, {z}) OVER () * {z}"
            ry = f"{y} - regr_intercept({y}, {z}) OVER () - regr_slope({y}, {z}) OVER () * {z}"
        else:
            rx, ry = f"{x} - avg({x}) OVER ()", f"{y} - avg({y}) OVER ()"
        rows.append(
            f"SELECT '{x}' AS x, '{y}' AS y, '{','.join(given)}' AS given, count(*) AS n, "
            f"sqrt(count(*)) * avg(rr) / stddev_pop(rr) AS statistic FROM (SELECT ({rx}) * ({ry}) AS rr FROM filled)"
        )
    return " UNION ALL ".join(rows)


@query(
    "residual_independence_test",
    with_(
        OBS, _filled(["x_disc", "x_qty", "x_price", "x_size"]), f"tests AS ({_gcm_sql()})",
        select=f"SELECT x, y, given, n, {r('statistic')} AS statistic, abs(statistic) > 1.959963984540054::double AS dependent FROM tests",
    ),
)
def residual_independence_test(spark, sf_dir):
    obs = observations(spark, sf_dir, ["x_disc", "x_qty", "x_price", "x_size", LABEL])
    t = falsify.test_table(obs, GCM_TESTS)
    return t.select(
        "x", "y", F.concat_ws(",", "given").alias("given"), "n", rounded("statistic").alias("statistic"), (F.col("p_value") < 0.05).alias("dependent")
    )


OBS_NODES = sorted({n for e in OBS_GRAPH for n in e})


def _falsify_sql() -> list[str]:
    """The stand-in graph and its renamings only imply marginal independencies between the parents of one node."""
    pairs = [(a, b) for i, a in enumerate(OBS_NODES) for b in OBS_NODES[i + 1 :]]
    tests = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, abs(sqrt(count(*)) * avg(rr) / stddev_pop(rr)) > 1.959963984540054::double AS violated "
        f"FROM (SELECT ({a} - avg({a}) OVER ()) * ({b} - avg({b}) OVER ()) AS rr FROM filled)"
        for a, b in pairs
    )
    return [
        OBS,
        _filled([n for n in OBS_NODES if n != LABEL]),
        f"tests AS ({tests})",
        "nodes AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in OBS_NODES) + "]) AS node)",
        f"""renamed AS (SELECT perm, a.node, b.node AS mapped FROM
            (SELECT perm, node, row_number() OVER (PARTITION BY perm ORDER BY node) AS pos FROM nodes, range({study.GRAPH_PERMUTATIONS}) r(perm)) a
            JOIN (SELECT perm, node, row_number() OVER (PARTITION BY perm ORDER BY md5(concat('perm:', perm, ':', node))) AS pos
                  FROM nodes, range({study.GRAPH_PERMUTATIONS}) r(perm)) b USING (perm, pos)
            UNION ALL SELECT -1, node, node FROM nodes)""",
        """conditions AS (SELECT a.perm, least(a.mapped, b.mapped) AS x, greatest(a.mapped, b.mapped) AS y
            FROM renamed a JOIN renamed b ON a.perm = b.perm AND a.node < b.node AND a.node <> 'y' AND b.node <> 'y')""",
        """per_graph AS (SELECT perm, count(*) AS conditions, count(*) FILTER (violated) AS violations, string_agg(x || y, ',' ORDER BY x, y) AS listed
            FROM conditions JOIN tests USING (x, y) GROUP BY perm)""",
    ]


@query(
    "falsify_graph",
    with_(
        *_falsify_sql(),
        select=f"""SELECT 'obs' AS graph, any_value(o.conditions) AS conditions, any_value(o.violations) AS violations, count(*) AS permutations,
        {r('avg(CASE WHEN p.violations <= o.violations THEN 1.0::double ELSE 0 END)')} AS p_violations,
        {r('avg(CASE WHEN p.listed = o.listed THEN 1.0::double ELSE 0 END)')} AS p_equivalent,
        {r('avg(p.violations)')} AS mean_permuted_violations
        FROM per_graph p, per_graph o WHERE o.perm = -1 AND p.perm >= 0""",
    ),
)
def falsify_graph(spark, sf_dir):
    """The stand-in graph, every feature acting on the target, against 500 node permutations."""
    return _falsified(spark, sf_dir, {"obs": OBS_GRAPH})


ISOLATED = {g: [STAND_IN[n] for n in own] for g, own in study.ISOLATED.items()}
CANDIDATES = {g: GRAPHS[g] for g in study.CANDIDATE_GRAPHS}


@query("falsify_study_graphs")
def falsify_study_graphs(spark, sf_dir):
    """The study's final and candidate graphs on stand-in columns; conditions have up to five given variables."""
    return _falsified(spark, sf_dir, GRAPHS)


@query("falsify_boosted")
def falsify_boosted(spark, sf_dir):
    """The six candidate graphs against 500 node permutations each, residuals by boosted trees grown in shared scans."""
    return _falsified(spark, sf_dir, CANDIDATES, learner="gbt", rounds=5, rate=0.3, max_depth=2)


def _falsified(spark, sf_dir, graphs, **options):
    nodes = sorted({n for edges in graphs.values() for e in edges for n in e} | {n for g, own in ISOLATED.items() if g in graphs for n in own})
    report = falsify.falsify_graphs(observations(spark, sf_dir, nodes), graphs, study.GRAPH_PERMUTATIONS, isolated=ISOLATED, **options)
    return report.withColumns({c: rounded(c) for c in ("p_violations", "p_equivalent", "mean_permuted_violations")})


# Every pair of a graph's nodes under the empty set and every set of one other node.
SEPARATION_SQL = """nodes AS (SELECT graph, unnest([src, dst]) AS node FROM edges UNION SELECT graph, node FROM alone),
    asked AS (SELECT a.graph, a.node AS x, b.node AS y, '' AS given FROM nodes a JOIN nodes b ON a.graph = b.graph AND a.node < b.node
        UNION ALL SELECT a.graph, a.node, b.node, c.node FROM nodes a JOIN nodes b ON a.graph = b.graph AND a.node < b.node
        JOIN nodes c ON c.graph = a.graph AND c.node NOT IN (a.node, b.node)),
    opened AS (SELECT DISTINCT graph, given, given AS node FROM asked WHERE given <> ''
        UNION SELECT asked.graph, given, ancestor FROM asked JOIN reach ON reach.graph = asked.graph AND reach.node = given),
    walk AS (SELECT graph, x, y, given, x AS node, true AS up FROM asked
        UNION SELECT w.graph, w.x, w.y, w.given, s.node, s.up FROM walk w JOIN steps s ON s.graph = w.graph AND s.given = w.given AND s.src = w.node AND s.was_up = w.up)"""
STEPS_SQL = """steps AS (SELECT e.graph, g.given, e.src, u.was_up, e.dst AS node, false AS up FROM edges e JOIN (SELECT DISTINCT graph, given FROM asked) g USING (graph)
        CROSS JOIN (VALUES (true), (false)) u(was_up) WHERE e.src <> g.given
        UNION ALL SELECT e.graph, g.given, e.dst, true, e.src, true FROM edges e JOIN (SELECT DISTINCT graph, given FROM asked) g USING (graph) WHERE e.dst <> g.given
        UNION ALL SELECT e.graph, o.given, e.dst, false, e.src, true FROM edges e JOIN opened o ON o.graph = e.graph AND o.node = e.dst)"""
ALONE = "alone AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{n}')" for g, own in ISOLATED.items() for n in own) + ") t(graph, node))"
_NODES_CTE, _ASKED_ON = SEPARATION_SQL.split("\n    walk AS", 1)


@query(
    "d_separation",
    with_(
        OBS, EDGES, REACH, COVERAGE, ALONE, _NODES_CTE.rstrip().rstrip(","), STEPS_SQL, "walk AS" + _ASKED_ON,
        select="""SELECT asked.graph, x, y, given, complete, NOT EXISTS (SELECT 1 FROM walk w WHERE w.graph = asked.graph AND w.x = asked.x AND w.y = asked.y
            AND w.given = asked.given AND w.node = asked.y) AS separated FROM asked JOIN coverage ON a = x AND b = y""",
        recursive=True,
    ),
)
def d_separation(spark, sf_dir):
    """Which pairs of nodes a graph separates, without and with one given node, beside the rows that have both."""
    edges, coverage = _edges_and_coverage(spark, sf_dir)
    nodes = graph.node_table(edges, graph.isolated_nodes(spark, ISOLATED))
    x, y, z = (nodes.select("graph", F.col("node").alias(c)) for c in "xyz")
    pairs = x.join(y, "graph").where("x < y")
    single = pairs.join(z, "graph").where("z <> x and z <> y").select("graph", "x", "y", F.array("z").alias("given"))
    told = graph.d_separated(edges, pairs.select("graph", "x", "y", F.array().cast("array<string>").alias("given")).unionByName(single))
    both = (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
    return told.join(coverage, both).select("graph", "x", "y", F.concat_ws(",", "given").alias("given"), "complete", "separated")


@query("minimal_adjustment_set")
def minimal_adjustment_set(spark, sf_dir):
    """A smallest backdoor set of every node that is not the target, with the rows that have both."""
    edges, coverage = _edges_and_coverage(spark, sf_dir)
    alone = graph.isolated_nodes(spark, ISOLATED)
    treatments = graph.node_table(edges, alone).where(F.col("node") != LABEL).withColumnRenamed("node", "treatment")
    sets = graph.minimal_adjustment_sets(edges, treatments, LABEL, alone)
    both = coverage.where(F.col("b") == LABEL).select(F.col("a").alias("treatment"), "complete")
    return sets.join(both, "treatment").select("graph", "treatment", F.concat_ws(",", "adjustment").alias("adjustment"), "complete")
