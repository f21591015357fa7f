"""Collocations by stripes against plain counters; the SQL check of the registered query runs with the others."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraquant.llm import collocations


def _plain(rows, min_count, percent, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            holders = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= percent * a for b in holders):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


TEXT = "In der Tat, in der Tat war es so: new york city is new york! A\tb c. a b c; a b é 漢字 é 漢字\x0bé 漢字? "
ROWS = [("de", TEXT * 9), ("de", TEXT), (None, TEXT.upper() * 4), ("en", None), ("en", ""), ("fr", "x" * 50_000 + " y " + "x" * 50_000), ("fr", "the the " * 5000), ("de", TEXT)]


@pytest.mark.parametrize(("min_count", "top", "flush"), ((10, 2000, 1 << 22), (2, 3, 1 << 22), (3, 2000, 50)))
def test_against_counters(spark, monkeypatch, min_count, top, flush):
    monkeypatch.setattr(collocations, "FLUSH", flush)
    df = spark.createDataFrame(ROWS, "lang string, text string").repartition(3)
    for name in ("phrase", "prefix", "n", "a", "score", "rank", "length"):
        df = df.withColumn(name, F.lit("clash"))
    got = collocations.collocations(df, min_count=min_count, top=top).collect()
    assert sorted(tuple(r) for r in got) == _plain(ROWS, min_count, 50, top)
    assert got and collocations.collocations(df.limit(0)).count() == 0


def test_merge_over_batches_and_hot_prefixes(spark, monkeypatch):
    """A stripe that is cut by batches, and prefixes that are dealt over parts, give the same sums."""
    monkeypatch.setattr(collocations, "HOT_SHARE", 0.01)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        rows = [("en", " ".join(f"hot w{(i * k) % 37} and" for i in range(60))) for k in range(1, 40)]
        df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
        got = collocations.collocations(df, min_count=2).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(tuple(r) for r in got) == _plain(rows, 2, 50, 2000)


def test_scores_past_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    counts = spark.createDataFrame(
        [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)], "lang string, phrase string, length int, f long"
    )
    sizes = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (counts, sizes))
    row = collocations.collocations(spark.createDataFrame([("en", "")], "lang string, text string")).collect()[0]
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))


def test_a_task_makes_one_row_a_part(spark):
    """Rows of blocks are bounded by tasks and partitions, whatever the number of buckets in them."""
    rows = [("en", " ".join(f"w{(i * k) % 997}" for i in range(3000))) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    blocks = collocations.partial_stripes(df, 1, None, frozenset(), "lang", "text")
    assert blocks.count() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
