"""Scans, sources, sinks and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import contracts
from ..sources import artefacts
from ..sources.tables import ALL_FEATURES, FEATURES, KEY, LABEL, TIEBREAK, observations, table
from ..session import fresh_path
from .common import SCENARIOS
from .oracle import FITTED, OBS, r, with_
from .registry import query

MODEL_COLUMNS = [*FEATURES, "x_total", LABEL]


@query(
    "scan_observations",
    with_(OBS, select=f"SELECT obs_key, x_qty, x_disc, x_total, x_size, {r('y')} AS y FROM obs"),
)
def scan_observations(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, *MODEL_COLUMNS])
    return obs.withColumn(LABEL, rounded(LABEL))


@query(
    "scan_residual_csv",
    with_(
        OBS,
        select="SELECT obs_key, x_disc FROM obs WHERE x_disc IS NOT NULL AND x_size::bigint % 5 <> 0",
    ),
)
def scan_residual_csv(spark, sf_dir):
    """Written as CSV with a byte-order mark and unreadable cells, then read back."""
    obs = observations(spark, sf_dir, [KEY, "x_disc", "x_size"])
    text = F.when(F.col("x_size").cast("bigint") % 5 == 0, F.lit("n/a")).otherwise(F.col("x_disc").cast("string"))
    path = fresh_path(spark, "residual-csv")
    artefacts.write_csv_with_bom(obs.select(KEY, text.alias("x_disc")), path)
    back = artefacts.read_csv_with_bom(spark, path, [KEY, "x_disc"])
    return artefacts.numeric_column(back, "x_disc", keep=[KEY])


@query(
    "metadata_roundtrip",
    with_(
        OBS,
        select=f"""SELECT 'y' AS target, 1::int AS chosen_run, 0::int AS random_state, 0.7::double AS train, 0.3::double AS test,
        'x_qty,x_disc,x_size' AS features, count(*)::varchar AS rows_param,
        {r('quantile_cont(y, 0.01)')} AS low, {r('quantile_cont(y, 0.99)')} AS high FROM obs""",
    ),
)
def metadata_roundtrip(spark, sf_dir):
    from ..operators.clean import quantile_bounds

    b = quantile_bounds(observations(spark, sf_dir, [LABEL]), LABEL)
    spec = spark.range(1).select(
        F.lit(1).alias("chosen_run"),
        F.lit(0).alias("random_state"),
        F.struct(F.lit(0.7).alias("train"), F.lit(0.3).alias("test")).alias("split"),
        F.lit(5).alias("cv"),
        F.create_map(F.lit("rows"), F.lit(str(b.rows))).alias("best_params"),
        F.array(*[F.lit(f) for f in FEATURES]).alias("selected_features"),
        F.lit(LABEL).alias("target"),
        F.struct(F.lit(b.low).alias("low_0.01"), F.lit(b.high).alias("high_0.99")).alias("clip_quantiles"),
    )
    path = fresh_path(spark, "metadata")
    artefacts.write_metadata(spec, path)
    m = artefacts.read_metadata(spark, path)
    return m.select(
        "target", "chosen_run", "random_state", F.col("split.train").alias("train"), F.col("split.test").alias("test"),
        F.concat_ws(",", "selected_features").alias("features"),
        F.col("best_params")["rows"].alias("rows_param"),
        rounded(F.col("clip_quantiles.`low_0.01`")).alias("low"),
        rounded(F.col("clip_quantiles.`high_0.99`")).alias("high"),
    )


@query(
    "sink_result_set",
    with_(
        OBS,
        select=f"""SELECT 'by_place' AS result_table, place AS label, count(*) AS n, {r('avg(y)')} AS mean_y FROM obs GROUP BY place
        UNION ALL SELECT 'by_scenario', scenario, count(*), {r('avg(y)')} FROM obs GROUP BY scenario""",
    ),
)
def sink_result_set(spark, sf_dir):
    obs = observations(spark, sf_dir, ["place", "scenario", LABEL])
    mean = [F.count(F.lit(1)).alias("n"), rounded(F.avg(LABEL)).alias("mean_y")]
    results = {
        f"by_{c}": obs.groupBy(F.col(c).alias("label")).agg(*mean).withColumn("result_table", F.lit(f"by_{c}"))
        for c in ("place", "scenario")
    }
    path = fresh_path(spark, "results")
    artefacts.write_bundle(results, path)
    back = artefacts.read_bundle(spark, path, list(results))
    return back["by_place"].unionByName(back["by_scenario"])


@query(
    "check_required_columns",
    with_(
        OBS,
        select="""SELECT * FROM (
        SELECT 'x_qty' AS "column", true AS present, count(x_qty) AS filled FROM obs
        UNION ALL SELECT 'x_disc', true, count(x_disc) FROM obs
        UNION ALL SELECT 'x_size', true, count(x_size) FROM obs
        UNION ALL SELECT 'x_depth', false, 0)""",
    ),
)
def check_required_columns(spark, sf_dir):
    return contracts.check_required_columns(observations(spark, sf_dir, FEATURES), [*FEATURES, "x_depth"])


@query(
    "add_missing_columns",
    with_(OBS, select="SELECT obs_key, x_size, NULL::double AS x_depth, NULL::double AS x_ph FROM obs"),
)
def add_missing_columns(spark, sf_dir):
    return contracts.add_missing_columns(observations(spark, sf_dir, [KEY, "x_size"]), ["x_size", "x_depth", "x_ph"])


@query(
    "check_row_contract",
    with_(
        OBS,
        """labels AS (SELECT string_agg(scenario, '|' ORDER BY scenario) AS l FROM (SELECT DISTINCT scenario FROM obs WHERE scenario <> 'AUTOMOBILE'))""",
        """facts AS (SELECT (SELECT count(*)::varchar FROM obs) AS n, (SELECT l FROM labels) AS l,
        (SELECT count(DISTINCT place)::varchar FROM obs) AS p, (SELECT count(*)::varchar FROM obs WHERE y IS NULL) AS m)""",
        select="""SELECT 'rows' AS rule, '60000' AS expected, n AS actual, n = '60000' AS ok FROM facts
        UNION ALL SELECT 'labels', 'BUILDING|FURNITURE|HOUSEHOLD|MACHINERY', l, l = 'BUILDING|FURNITURE|HOUSEHOLD|MACHINERY' FROM facts
        UNION ALL SELECT 'places', '25', p, p = '25' FROM facts
        UNION ALL SELECT 'targets_missing', '0', m, m = '0' FROM facts""",
    ),
)
def check_row_contract(spark, sf_dir):
    from ..operators.clean import label_filter_ordered

    obs = observations(spark, sf_dir, ["place", "scenario", LABEL])
    rows = contracts.check_row_contract(
        obs,
        {
            "rows": ("60000", F.count(F.lit(1))),
            "places": ("25", F.count_distinct("place")),
            "targets_missing": ("0", F.count_if(F.col(LABEL).isNull())),
        },
    )
    listed = label_filter_ordered(obs.select("scenario"), "scenario", SCENARIOS)
    labels = contracts.check_row_contract(listed, {"labels": ("|".join(SCENARIOS), contracts.ordered_labels("scenario", "pos"))})
    return rows.unionByName(labels)


@query(
    "check_metadata_contract",
    with_(
        OBS,
        """spec AS (SELECT 'y' AS target, count(*) AS n, count(x_qty) AS filled FROM obs)""",
        select="""SELECT 'target' AS item, 'y' AS expected, target AS actual, target = 'y' AS ok FROM spec
        UNION ALL SELECT 'split.test', '0.3', '0.3', true FROM spec
        UNION ALL SELECT 'cv', '10', '5', false FROM spec
        UNION ALL SELECT 'rows', '60000', n::varchar, n = 60000 FROM spec
        UNION ALL SELECT 'filled', '0', filled::varchar, filled = 0 FROM spec""",
    ),
)
def check_metadata_contract(spark, sf_dir):
    spec = observations(spark, sf_dir, ["x_qty"]).agg(
        F.lit(LABEL).alias("target"),
        F.struct(F.lit(0.7).alias("train"), F.lit(0.3).alias("test")).alias("split"),
        F.lit(5).alias("cv"),
        F.count(F.lit(1)).alias("rows"),
        F.count("x_qty").alias("filled"),
    )
    return contracts.check_metadata_contract(
        spec, {"target": LABEL, "split.test": 0.3, "cv": 10, "rows": 60000, "filled": 0}
    )


@query(
    "content_hash_manifest",
    """WITH actual AS (SELECT doc_id, sha256(text) AS sha256 FROM documents),
    manifest AS (SELECT doc_id, sha256(trim(text)) AS expected FROM documents UNION ALL SELECT -1 - doc_id, sha256('') FROM labels)
    SELECT manifest.doc_id, expected, sha256 AS actual,
      CASE WHEN sha256 IS NULL THEN 'missing' WHEN sha256 = expected THEN 'ok' ELSE 'mismatch' END AS status
    FROM manifest LEFT JOIN actual ON manifest.doc_id = actual.doc_id""",
)
def content_hash_manifest(spark, sf_dir):
    """Document texts as artefacts against a manifest of hashes of their trimmed texts, plus absent entries."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    actual = docs.select("doc_id", artefacts.content_hash("text").alias("sha256"))
    manifest = docs.select("doc_id", F.sha2(F.trim("text"), 256).alias("sha256")).unionByName(
        table(spark, sf_dir, "labels").select((-1 - F.col("doc_id")).alias("doc_id"), F.sha2(F.lit(""), 256).alias("sha256"))
    )
    return artefacts.check_manifest(actual, manifest, "doc_id")


@query(
    "numeric_columns",
    with_(
        OBS,
        select=" UNION ALL ".join(f"""SELECT '{c}' AS "column", 'double' AS "type", count({c}) AS filled FROM obs""" for c in [TIEBREAK, *ALL_FEATURES]),
    ),
)
def numeric_columns(spark, sf_dir):
    return contracts.numeric_column_report(observations(spark, sf_dir), exclude=[LABEL])
