"""Exact order statistics against sorting in memory."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.functions import order_stats
from terraquant.functions.order_stats import exact_quantiles, hash_order_cutoffs, hash_order_index, value_order_rank

RNG = np.random.default_rng(5)
COLUMNS = {
    "uniform": RNG.random(5000),
    "heavy_tail": np.exp(RNG.normal(0, 4, 5000)),
    "one_third_equal": np.where(RNG.random(5000) < 0.34, 7.0, RNG.normal(7, 3, 5000)),
    "two_values": np.where(RNG.random(5000) < 0.01, 1.0, 2.0),
    "constant": np.full(50, 3.25),
    "single": np.array([1.5]),
}
PROBS = [0.0, 0.01, 0.025, 0.5, 0.975, 0.99, 1.0]


@pytest.mark.parametrize("direct", [500_000, 40, 1])
@pytest.mark.parametrize("name", list(COLUMNS))
def test_exact_quantiles(spark, monkeypatch, name, direct):
    if direct < 1000:
        # A coarse sketch and a tiny fetch limit force further rounds.
        monkeypatch.setattr(order_stats, "SKETCH_ACCURACY", 50)
    if direct == 1 and name not in ("one_third_equal", "two_values"):
        pytest.skip("many rounds; covered by the skewed columns")
    values = COLUMNS[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "y double").repartition(4)
    got, n = exact_quantiles(df, "y", PROBS, direct_rows=direct)
    assert n == len(values)
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-13)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "y double"), "y", [0.5]) == ([None], 0)


def keyed(spark, n, parts):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 3).alias("t")).repartition(parts)


def hash_order(n, tag):
    return sorted((hashlib.md5(f"{tag}:k{i}".encode()).hexdigest(), f"k{i}") for i in range(n))


@pytest.mark.parametrize("parts", [1, 7])
def test_hash_order_cutoffs(spark, parts):
    n = 3000
    row = hash_order_cutoffs(keyed(spark, n, parts), "s", "key", ["t"], lambda n: [F.lit(1), F.ceil(n * 0.3).cast("bigint"), n]).first()
    order = hash_order(n, "s")
    assert row["n"] == n
    assert [(c["h"], c["k"]) for c in row["cuts"]] == [order[0], order[899], order[-1]]


def test_hash_order_index(spark):
    got = {r["key"]: r["idx"] for r in hash_order_index(keyed(spark, 2000, 5), "p", "key", ["t"]).collect()}
    assert got == {k: i for i, (_, k) in enumerate(hash_order(2000, "p"))}


def test_value_order_rank_with_a_hot_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id") * 1.0).alias("v"), F.col("id").alias("k"))
    got = value_order_rank(df, [F.desc("v"), F.asc("k")], partitions=6).collect()
    want = sorted(((r["v"], r["k"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["k"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
