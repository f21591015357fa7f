"""Every query with an SQL oracle, and every other query's row check, at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check_oracle import compare, connect

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# Slow rows-only queries are exercised piece by piece in the other modules.
ROWS_ONLY = [n for n in QUERIES if n not in ORACLES and n not in ("compare_all_models", "falsify_study_graphs", "falsify_boosted", "feature_importance")]


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, sf_dir, name):
    ok, note, _, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "place", "prediction"]
    assert df.count() == 25
