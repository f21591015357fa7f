"""Importance resampling and its quickselect against plain Python."""

import hashlib
import math
import random
import re
import zlib

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from terraquant.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], len(words)


def _plain(docs, target, percent=25, min_words=20):
    """doc_id -> (n_features, weight, score, rank), from the contract alone; ids are unique."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, docs.values()), (t, target)):
        for text in texts:
            for f in _features(text)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    out, eligible = {}, []
    for i, text in docs.items():
        found, words = _features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None]
        if words >= min_words:
            eligible.append(i)
    eligible.sort(key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(eligible[: percent * len(eligible) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("sf", ("sf0.001", "sf0.01"))
def test_op11_against_plain_python(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    target = [r["text"] for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = entry.queries()["op11_importance_resampling"](spark, path)
    assert [t for c, t in got.dtypes] == ["bigint"] * 5
    got = got.collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got} == _plain(docs, target)
    assert len(got) == len(docs)


def test_edges(spark):
    long = " ".join(f"Word{i % 977},and" for i in range(60_000))
    same = " ".join(f"a{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, long), (4, " \t\n"), (5, same), (5, same), (5, same), (5, same), (None, same), (None, same), (7, "É漢字 x" * 20), (8, "é" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "score", "weight", "rank", "n_words", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    target = spark.createDataFrame([(1, "a1 a2 a3"), (2, None)], "item_id long, text string")
    got = importance.resample(df, target, percent=50).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    # Long text, six equal ones and the mixed one have 20 words: four places; equal rows share a score but no rank.
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in drawn] == sorted((r["score"] for r in drawn), reverse=True)
    assert all(r["weight"] == 0 and r["n_features"] == 0 for r in got if r["doc_id"] in (1, 2, 4))
    assert importance.resample(df.limit(0), target).count() == 0
    assert {r["rank"] for r in importance.resample(df, target.limit(0), percent=0).collect()} == {None}


@pytest.mark.parametrize("pivots", (1, 2, 31))
def test_quickselect_meets_every_rank(spark, pivots):
    rng = random.Random(pivots)
    scores = [(rng.choice([None, *range(6)]), rng.randrange(-3, 3), 0, 1) for _ in range(40)]
    rows = importance._key(spark.createDataFrame(scores, "doc_id long, score long, weight long, n_features long")).cache()
    order = sorted((-s, i is None, i or 0) for i, s, _, _ in scores)
    for k in (1, 2, 17, 39, 40):
        key = importance.kth_key(rows, k, pivots)
        assert (key["a"], key["b"], key["c"] or 0) == order[k - 1]
