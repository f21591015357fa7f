"""Queries of the training-data operators against their SQL, and those without SQL against brute force."""

import hashlib
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as entry
from check_oracle import compare, connect

from terraquant.llm import bpe, packing

WITH_SQL = sorted(n for n in entry.oracle_sql() if n.startswith("op"))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, sf_dir, name):
    ok, note, _, _ = compare(spark, connect(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, note


def test_op1_against_tiktoken(spark, sf_dir, documents):
    import tiktoken

    ranks = bpe._parse(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = entry.queries()["op1_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(documents)
    for r in got:
        text = documents[r["doc_id"]]["text"] or ""
        ids = known.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op3_held_out_accuracy(spark, documents):
    got = entry.queries()["op3_language_id"](spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def _components(fps: dict[int, int], distance: int = 2) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([fps[i] for i in ids], np.uint64)
    for i, a in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance):
            x, y = find(a), find(ids[j])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _plain_fingerprint(text: str) -> int:
    import xxhash

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def test_op5_against_all_pairs(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in entry.queries()["op5_simhash"](spark, sf_dir).collect()}
    fps = {i: _plain_fingerprint(r["text"] or "") for i, r in documents.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == _components(fps)


def _ids(texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_packed(pieces, texts: dict[int, str]):
    """Every id in one piece, windows gapless and within 2048."""
    ids = dict(zip(texts, _ids(list(texts.values())), strict=True))
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[doc])
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    return by_window


def test_op7_packs_every_id_once(spark, sf_dir, documents):
    pieces = entry.queries()["op7_packing"](spark, sf_dir).collect()
    windows = check_packed(pieces, {i: r["text"] or "" for i, r in documents.items()})
    fills = [sum(p["length"] for p in w) for w in windows.values()]
    assert sum(f < packing.CAPACITY for f in fills) <= 8  # at most one a task


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in entry.queries()["op9_quality_knn"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i], q) for i, q in labels.items() if got[i]["held_out"]]
    good, bad = [r for r, q in held if q == 1], [r for r, q in held if q == 0]
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.15 * len(bad)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_op10_finds_the_notices(spark, documents):
    rows = entry.queries()["op10_licence_scan"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    expected = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    }
    planted = {(i, k, expected[x]) for i, t in texts.items() for k, x in enumerate(t.split("\n")) if x in expected}
    found = {(r["doc_id"], r["number"], r["family"]) for r in rows if r["confirmed"]}
    assert planted and planted <= found
