"""Splits, folds and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import prep, split
from ..sources.tables import FEATURES, KEY, LABEL, TIEBREAK, observations
from .common import split_rows
from .oracle import BASE, OBS, is_test, prep as prep_sql, r, with_
from .oracle import bits
from .registry import query

SEEDS = 50


@query(
    "split_exact",
    with_(
        OBS,
        "ordered AS (SELECT *, row_number() OVER (ORDER BY md5(concat(7, ':', obs_key)), obs_key, tiebreak) AS rn, count(*) OVER () AS n FROM obs)",
        select="SELECT obs_key, tiebreak, rn <= ceil(n * 0.3) AS is_test FROM ordered",
    ),
)
def split_exact(spark, sf_dir):
    return split.split_exact(observations(spark, sf_dir, [KEY, TIEBREAK]), 7, KEY, [TIEBREAK])


@query("split_threshold", with_(OBS, select=f"SELECT obs_key, {is_test(5)} AS is_test FROM obs"))
def split_threshold(spark, sf_dir):
    return split.split_threshold(observations(spark, sf_dir, [KEY]), 5, KEY)


@query(
    "replicate_splits",
    with_(
        OBS,
        f"seeded AS (SELECT seed, y, {is_test('seed')} AS is_test FROM obs CROSS JOIN (SELECT range AS seed FROM range({SEEDS})) s)",
        select=f"SELECT seed::int AS seed, is_test, count(*) AS n, {r('avg(y)')} AS mean_y FROM seeded GROUP BY ALL",
    ),
)
def replicate_splits(spark, sf_dir):
    rows = split.replicate_splits(observations(spark, sf_dir, [KEY, LABEL]), SEEDS, KEY)
    return rows.groupBy("seed", "is_test").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(LABEL)).alias("mean_y"))


@query(
    "kfold_assign",
    with_(
        OBS,
        "ordered AS (SELECT *, ntile(10) OVER (ORDER BY md5(concat('fold3:', obs_key)), obs_key, tiebreak) - 1 AS contiguous FROM obs)",
        select=f"SELECT obs_key, tiebreak, ({bits(repr('fold42'))} % 5)::int AS shuffled, contiguous::int AS contiguous FROM ordered",
    ),
)
def kfold_assign(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, TIEBREAK])
    both = split.kfold_contiguous(split.kfold_shuffled(obs, 5, 42, KEY, "shuffled"), 10, 3, KEY, [TIEBREAK], "contiguous")
    return both.select(KEY, TIEBREAK, "shuffled", "contiguous")


@query(
    "impute_mean",
    with_(
        *BASE,
        prep_sql(scale=False),
        select=f"SELECT obs_key, tiebreak, is_test, {r('z1')} AS x_qty, {r('z2')} AS x_disc, {r('z3')} AS x_size FROM prepped",
    ),
)
def impute_mean(spark, sf_dir):
    rows = prep.impute_mean(split_rows(spark, sf_dir), FEATURES, train=~F.col("is_test"))
    return rows.select(KEY, TIEBREAK, "is_test", *[rounded(f).alias(f) for f in FEATURES])


@query(
    "minmax_scale",
    with_(
        *BASE,
        prep_sql(),
        select=f"SELECT obs_key, tiebreak, is_test, {r('z1')} AS x_qty, {r('z2')} AS x_disc, {r('z3')} AS x_size FROM prepped",
    ),
)
def minmax_scale(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    stats = prep.fit_preprocessing(rows, FEATURES, train=~F.col("is_test"))
    rows = prep.apply_preprocessing(rows, stats, FEATURES)
    return rows.select(KEY, TIEBREAK, "is_test", *[rounded(f).alias(f) for f in FEATURES])


@query(
    "impute_scale_by_seed",
    with_(
        OBS,
        f"seeded AS (SELECT obs.*, seed, {is_test('seed')} AS is_test FROM obs CROSS JOIN (SELECT range AS seed FROM range(8)) s)",
        prep_sql(src="seeded", by="seed"),
        select="SELECT seed::int AS seed, is_test, "
        + ", ".join(f"{r(f'avg({z})')} AS mean_{f}, {r(f'max({z})')} AS max_{f}" for z, f in zip(("z1", "z2", "z3"), FEATURES))
        + " FROM prepped GROUP BY ALL",
    ),
)
def impute_scale_by_seed(spark, sf_dir):
    rows = split.replicate_splits(observations(spark, sf_dir, [KEY, *FEATURES]), 8, KEY)
    encoded = prep.impute_by_seed(rows, FEATURES, 8)
    return encoded.groupBy("seed", "is_test").agg(
        *[a for f in FEATURES for a in (rounded(F.avg(f)).alias(f"mean_{f}"), rounded(F.max(f)).alias(f"max_{f}"))]
    )


@query(
    "impute_whole_table",
    with_(
        OBS,
        prep_sql(src="obs", train="true", scale=False, name="plain"),
        prep_sql(src="obs", train="true", name="scaled"),
        select=f"""SELECT obs_key, tiebreak, 'imputed' AS variant, {r('z1')} AS x_qty, {r('z2')} AS x_disc, {r('z3')} AS x_size FROM plain
        UNION ALL SELECT obs_key, tiebreak, 'scaled', {r('z1')}, {r('z2')}, {r('z3')} FROM scaled""",
    ),
)
def impute_whole_table(spark, sf_dir):
    obs = observations(spark, sf_dir, [KEY, TIEBREAK, *FEATURES])
    plain = prep.impute_whole_table(obs, FEATURES).withColumn("variant", F.lit("imputed"))
    scaled = prep.impute_whole_table(obs, FEATURES, scale=True).withColumn("variant", F.lit("scaled"))
    return plain.unionByName(scaled).select(KEY, TIEBREAK, "variant", *[rounded(f).alias(f) for f in FEATURES])
