"""Projections, filters, scalar expressions, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.expressions import rounded
from ..operators import clean
from ..session import materialise
from ..sources import study
from ..sources.tables import ALL_FEATURES, FEATURES, KEY, LABEL, TIEBREAK, observations
from .common import SCENARIOS, clipped, scored
from .oracle import BOUNDS, CLIPPED, OBS, SCORED, r, with_
from .registry import query

PLACES_SQL = "(" + ", ".join(f"('{s}', '{o}', '{e}')" for s, o, e in study.PROVINCES) + ")"


@query(
    "coerce_numeric",
    with_(
        OBS,
        """raw AS (SELECT obs_key, CASE WHEN x_size::bigint % 4 = 0 THEN 'n/a' WHEN x_size::bigint % 4 = 1 THEN ' ' || x_size::bigint::varchar
        ELSE x_size::bigint::varchar || '.5' END AS text FROM obs)""",
        select="SELECT obs_key, TRY_CAST(text AS DOUBLE) AS value FROM raw",
    ),
)
def coerce_numeric(spark, sf_dir):
    size = F.col("x_size").cast("bigint")
    text = (
        F.when(size % 4 == 0, F.lit("n/a"))
        .when(size % 4 == 1, F.concat(F.lit(" "), size.cast("string")))
        .otherwise(F.concat(size.cast("string"), F.lit(".5")))
    )
    raw = observations(spark, sf_dir, [KEY, "x_size"]).select(KEY, text.alias("value"))
    return clean.coerce_numeric(raw, ["value"])


@query("drop_null_target", with_(OBS, select="SELECT obs_key, x_disc, x_qty FROM obs WHERE x_disc IS NOT NULL"))
def drop_null_target(spark, sf_dir):
    return clean.drop_null_target(observations(spark, sf_dir, [KEY, "x_disc", "x_qty"]), "x_disc")


@query(
    "clip_by_quantile",
    with_(OBS, BOUNDS, CLIPPED, select=f"SELECT obs_key, tiebreak, x_qty, {r('y')} AS y FROM clipped"),
)
def clip_by_quantile(spark, sf_dir):
    return clipped(spark, sf_dir, [KEY, TIEBREAK, "x_qty"]).withColumn(LABEL, rounded(LABEL))


@query(
    "clip_report",
    with_(
        OBS,
        BOUNDS,
        select=f"""SELECT {r('lo')} AS low, {r('hi')} AS high, count(*) FILTER (y BETWEEN lo AND hi) AS kept,
        count(*) FILTER (NOT coalesce(y BETWEEN lo AND hi, false)) AS removed FROM obs, bounds GROUP BY lo, hi""",
    ),
)
def clip_report(spark, sf_dir):
    obs = observations(spark, sf_dir, [LABEL])
    report = clean.clip_report(obs, LABEL, clean.quantile_bounds(obs, LABEL))
    return report.withColumns({c: rounded(c) for c in ("low", "high")})


@query(
    "clip_by_stored_bounds",
    with_(
        OBS,
        "spec AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM obs WHERE scenario <> 'AUTOMOBILE')",
        select=f"SELECT obs_key, {r('y')} AS y FROM obs, spec WHERE y BETWEEN lo AND hi AND scenario = 'AUTOMOBILE'",
    ),
)
def clip_by_stored_bounds(spark, sf_dir):
    """Bounds fitted on four scenarios, stored, and applied to the fifth."""
    obs = observations(spark, sf_dir, [KEY, "scenario", LABEL])
    b = clean.quantile_bounds(obs.where(F.col("scenario") != "AUTOMOBILE"), LABEL)
    spec = spark.range(1).select(F.lit(b.low).alias("low"), F.lit(b.high).alias("high"))
    kept = clean.clip_by_spec(obs.where(F.col("scenario") == "AUTOMOBILE"), LABEL, spec, "low", "high")
    return kept.select(KEY, rounded(LABEL).alias(LABEL))


@query(
    "label_filter_ordered",
    with_(
        OBS,
        "wanted AS (SELECT * FROM (VALUES (0, 'MACHINERY'), (1, 'BUILDING'), (2, 'HOUSEHOLD')) t(pos, scenario))",
        select="SELECT pos, obs_key, scenario FROM obs JOIN wanted USING (scenario) ORDER BY pos, obs_key, tiebreak",
    ),
)
def label_filter_ordered(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, TIEBREAK, "scenario"])
    listed = clean.label_filter_ordered(obs, "scenario", ["MACHINERY", "BUILDING", "HOUSEHOLD"])
    return listed.orderBy("pos", KEY, TIEBREAK).select("pos", KEY, "scenario")


@query(
    "unit_convert_fill",
    with_(OBS, select=f"SELECT obs_key, {r('coalesce(x_total / 1000, 0.2::double)')} AS hlr FROM obs"),
)
def unit_convert_fill(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, "x_total"])
    return obs.select(KEY, rounded(X.litres_to_cubic_metres("x_total", study.DEFAULT_HLR_M3_M2_D)).alias("hlr"))


@query(
    "flux_to_annual",
    with_(
        OBS,
        select="""SELECT obs_key, round(power(10.0::double, y) * 24 / coalesce(x_size / 100, 0.2::double) / 1000 * 28 / 1000
        * 67828164300.0::double / 1000000, 0) AS t_co2eq FROM obs""",
    ),
)
def flux_to_annual(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, "x_size", LABEL])
    hlr = F.coalesce(F.col("x_size") / F.lit(100.0), F.lit(study.DEFAULT_HLR_M3_M2_D))
    annual = X.flux_to_annual(F.col(LABEL), hlr, study.GWP_CH4, study.WATER_VOLUME_M3_PER_YEAR)
    return obs.select(KEY, rounded(annual, 0).alias("t_co2eq"))


@query(
    "name_normalise",
    f"""WITH names AS (SELECT * FROM (VALUES {PLACES_SQL[1:-1]}) t(short, official, english)),
    listed AS (SELECT *, row_number() OVER (ORDER BY english) - 1 AS i FROM names),
    raw AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN c_mktsegment WHEN c_nationkey % 2 = 0 THEN ' ' || short || ' ' ELSE official END AS label
      FROM customer LEFT JOIN listed ON i = c_custkey % 34),
    full_names AS (SELECT c_custkey, coalesce(n.official, trim(label)) AS full_name FROM raw LEFT JOIN names n ON n.short = trim(label))
    SELECT c_custkey, full_name, coalesce(n.english, full_name) AS english FROM full_names LEFT JOIN names n ON n.official = full_name""",
)
def name_normalise(spark, sf_dir):
    from ..sources.tables import table

    listed = sorted(study.PROVINCES, key=lambda p: p[2])
    at = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in listed]), (F.col("c_custkey") % 34 + 1).cast("int"))
    label = (
        F.when(F.col("c_nationkey") % 5 == 4, F.col("c_mktsegment"))
        .when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(" "), at(0), F.lit(" ")))
        .otherwise(at(1))
    )
    raw = table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))
    return clean.name_normalise(raw, "label", study.PROVINCES).drop("label")


@query(
    "highlight_flag",
    with_(
        OBS,
        select="SELECT place, count(*) AS n, place IN ('NATION_1', 'NATION_2', 'ATLANTIS') AS focus FROM obs GROUP BY place",
    ),
)
def highlight_flag(spark, sf_dir):
    obs = observations(spark, sf_dir, ["place"])
    return obs.groupBy("place").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "focus", X.flagged("place", ["NATION_1", "NATION_2", "ATLANTIS"])
    )


@query(
    "scale_for_colour",
    with_(
        OBS,
        "by_place AS (SELECT place, avg(y) AS v FROM obs GROUP BY place)",
        select=f"SELECT place, {r('v')} AS v, {r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())')} AS share FROM by_place",
    ),
)
def scale_for_colour(spark, sf_dir):
    by_place = materialise(observations(spark, sf_dir, ["place", LABEL]).groupBy("place").agg(F.avg(LABEL).alias("v")), "place-means")
    return clean.scale_for_colour(by_place, "v").select("place", rounded("v").alias("v"), rounded("share").alias("share"))


@query(
    "padded_axis_range",
    with_(
        *SCORED,
        "span AS (SELECT least(min(y), min(prediction)) AS lo, greatest(max(y), max(prediction)) AS hi FROM scored)",
        select=f"SELECT {r('lo - 0.05 * (hi - lo)')} AS axis_min, {r('hi + 0.05 * (hi - lo)')} AS axis_max FROM span",
    ),
)
def padded_axis_range(spark, sf_dir):
    rows, _ = scored(spark, sf_dir)
    axis = clean.padded_axis_range(rows, [LABEL, "prediction"])
    return axis.select(rounded("axis_min").alias("axis_min"), rounded("axis_max").alias("axis_max"))


@query(
    "attach_by_key",
    with_(
        *SCORED,
        select=f"""SELECT o.obs_key, o.tiebreak, o.x_qty, {r('o.y', 4)} AS observed, {r('s.prediction', 4)} AS predicted
        FROM clipped o JOIN scored s USING (obs_key, tiebreak)""",
    ),
)
def attach_by_key(spark, sf_dir):
    rows, model = scored(spark, sf_dir)
    predictions = rows.select(KEY, TIEBREAK, rounded("prediction", 4).alias("predicted"))
    observed = rows.select(KEY, TIEBREAK, "x_qty", rounded(LABEL, 4).alias("observed"))
    return observed.join(predictions, [KEY, TIEBREAK])


@query(
    "broadcast_scenarios",
    with_(
        OBS,
        "s AS (SELECT scenario, avg(y) AS point FROM obs WHERE scenario <> 'AUTOMOBILE' GROUP BY scenario)",
        f"d AS (SELECT range + 1 AS simulation FROM range({study.N_SIMULATIONS}))",
        select=f"SELECT simulation, scenario, {r('point + (simulation % 7) / 10.0::double')} AS shifted FROM d CROSS JOIN s",
    ),
)
def broadcast_scenarios(spark, sf_dir):
    from ..operators.bootstrap import expand_draws

    obs = observations(spark, sf_dir, ["scenario", LABEL]).where(F.col("scenario").isin(SCENARIOS))
    points = obs.groupBy("scenario").agg(F.avg(LABEL).alias("point"))
    draws = expand_draws(points, study.N_SIMULATIONS)
    return draws.select("simulation", "scenario", rounded(F.col("point") + F.col("simulation") % 7 / F.lit(10.0)).alias("shifted"))


@query(
    "union_analyses",
    with_(
        OBS,
        select=f"""SELECT 'all' AS analysis, scenario, count(*) AS n, {r('avg(y)')} AS mean_y FROM obs GROUP BY scenario
        UNION ALL SELECT 'complete', scenario, count(*), {r('avg(y)')} FROM obs WHERE x_qty IS NOT NULL AND x_disc IS NOT NULL GROUP BY scenario""",
    ),
)
def union_analyses(spark, sf_dir):
    obs = observations(spark, sf_dir, ["scenario", "x_qty", "x_disc", LABEL])

    def summary(name, rows):
        agg = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(LABEL)).alias("mean_y"))
        return agg.withColumn("analysis", F.lit(name))

    complete = obs.where(F.col("x_qty").isNotNull() & F.col("x_disc").isNotNull())
    return summary("all", obs).unionByName(summary("complete", complete))
