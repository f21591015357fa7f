"""The similarity join of n-gram sets and the near-copy stage against all pairs."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from terraquant.llm import jaccard


def _set(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_components(sets: dict, similar: tuple[int, int]) -> dict:
    """Smallest key reachable by links of Jaccard similarity, from every pair that shares a token."""
    holders, shared, root = {}, {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for own in holders.values():
        for a in own:
            for b in own:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if similar[1] * n >= similar[0] * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def _check(spark, texts: dict, k: int, similar: tuple[int, int]):
    sets = {i: _set(t, k) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(df, ngram=k, similar=similar).collect()}
    roots = plain_components(sets, similar)
    assert got == {i: (len(s), roots[i]) for i, s in sets.items()}
    return roots


def _family(rng, size: int, changed: int, length: int = 120) -> list[str]:
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(changed + 1)):
            words[rng.randrange(length)] = f"c{rng.randrange(10**6)}"
        cut = rng.randrange(6)
        out.append(" ".join(words[cut:] if rng.random() < 0.3 else words))
    return out


@pytest.mark.parametrize("similar", ((85, 100), (80, 100), (1, 2)))
def test_families_of_near_copies(spark, similar):
    """Groups whose members link in chains, around a member that is not the smallest, or hardly at all."""
    rng = random.Random(similar[0])
    texts = [t for size, changed in ((30, 1), (30, 4), (30, 8), (40, 12), (2, 2), (2, 5)) for t in _family(rng, size, changed)]
    texts += [" ".join(f"p{i}" for i in range(50)) + f" own{k} tail{k % 3}" for k in range(25)]  # a passage that many share
    roots = _check(spark, dict(enumerate(texts)), 4, similar)
    assert 5 < len(set(roots.values())) < len(texts) - 30


def test_collided_names_and_coarse_counters(spark, monkeypatch):
    """Sets with one 64-bit name stay apart, and frequencies that tell nothing lose no link."""
    texts = dict(enumerate(_family(random.Random(5), 40, 3)))
    real = jaccard._key
    monkeypatch.setattr(jaccard, "_key", lambda s: (real(s)[0] % 5, real(s)[1]))
    monkeypatch.setattr(jaccard, "_frequency_classes", lambda rows: __import__("numpy").zeros(jaccard.COUNTERS, "uint8"))
    _check(spark, texts, 4, (85, 100))


def test_edges(spark):
    long = " ".join(f"word{i % 9973} and more" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, long), (4, long + " end"), (5, "a b"), (5, "A\tb"), (6, "b a"), (7, "\x0b\n"), (8, "a"), (None, "a"), (None, long), (None, "no id"), (9, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("node", "token", "n", "id", "t1", "component", "root", "kept", "center"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar_components(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (5, 5), (6, 6), (7, 7), (8, 8), (None, 8), (None, 3), (None, None), (9, 9)], key=str)
    assert jaccard.similar_components(df.limit(0)).count() == 0


def test_stage_keeps_no_similar_pair_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    sets = {i: _set(t, 5) for i, t in texts.items()}
    roots = plain_components(sets, (80, 100))
    bare = min(i for i, s in sets.items() if not s) if not all(sets.values()) else None
    assert left == {i for i, r in roots.items() if i == r and (sets[i] or i == bare)}


def test_stage_drops_planted_copies_near_the_threshold(spark):
    """Copies of 200 words with a few changed ones: every pair at 0.8 or more goes, most of them between 0.80 and 0.85."""
    rng, rows = random.Random(1), []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for k in rng.sample(range(200), 3 + i % 3):
            words[k] = "changed"
        rows.append((2 * i + 1, " ".join(words).upper()))
    sets = {i: _set(t, 5) for i, t in rows}
    similarity = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)}
    assert sum(0.8 <= s < 0.85 for s in similarity.values()) >= 15
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {i for i, _ in rows} - {i + 1 for i, s in similarity.items() if s >= 0.8}


def test_repeated_and_null_ids(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(100)) for c in "xyz")
    rows = [(5, x), (5, y), (3, x + " end"), (9, y), (None, z), (None, z + " end"), (7, None), (8, " "), (6, "a b"), (6, "a b")]
    rows += [(100 + i, f"{z} tail{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own_id", F.lit("clash")).withColumn("its_own_id", F.lit(1))
    got = jaccard.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, x + " end"), (5, y), (100, f"{z} tail0"), (7, None), (6, "a b")], key=str)
    assert jaccard.drop_near_copies(df.limit(0)).count() == 0


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    """Without lists of shared tokens, near copies within two bits are still dropped; wrong proposals change nothing."""
    from terraquant.llm import simhash

    base = [f"w{i * 7919 % 1009}" for i in range(600)]
    texts = {1: base, 2: [*base, "tail"], 3: [f"v{i}" for i in range(80)], 4: [f"v{i}" for i in range(60)] + [f"x{i}" for i in range(80)]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    sets = jaccard.token_sets([" ".join(t) for t in texts.values()], 5, jaccard._Hashes())
    assert (simhash.majority(sets[0]) ^ simhash.majority(sets[1])).bit_count() <= simhash.DISTANCE
    lists = jaccard._lists
    monkeypatch.setattr(jaccard, "_lists", lambda postings: lists(postings).limit(0))
    assert sorted(r["doc_id"] for r in jaccard.drop_near_copies(df).collect()) == [1, 3, 4]
    monkeypatch.setattr(
        jaccard, "_fingerprint_pairs",
        lambda nodes: nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))).where("a <> b"),
    )
    assert sorted(r["doc_id"] for r in jaccard.drop_near_copies(df).collect()) == [1, 3, 4]
