"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits
share at least six of them, the guaranteed minimum of matches. Postings of single bytes would each
hold 1/256 of all documents, so the index keeps a posting for every choice of six positions: the 28
smallest lists that meet the count by construction. A posting fixes six bytes, so it holds at most
65,536 different fingerprints, however many copies there are. Inside it the remaining two bytes of
every member are tallied against the masks of one and two bits and the links verified; members
found linked leave as a star, never as all pairs. Copies of one fingerprint are one member.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import smallest_reachable
from .shared import lower_arrow_batches

SHINGLE = 3
SEED = 42
DISTANCE = 2
# Shingles whose bits are tallied at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text: a bit is set where over half the shingle hashes set it.

    A-Z are lower-cased; words are what blanks and control line ends separate. Fewer words than a
    shingle make one shingle; no word gives zero.
    """
    import xxhash

    # Lower-casing and splitting bytes knows A-Z and the six ASCII separators only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return majority(hashes)


def majority(hashes: Sequence[int] | np.ndarray) -> int:
    """The bits that over half the 64-bit hashes set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at : at + BLOCK], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long); null texts have fingerprint zero."""
    lower_arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id bigint, fp bigint")


def shared_byte_masks(distance: int = DISTANCE) -> list[int]:
    """A mask for each choice of the positional bytes that any linked pair must share."""
    full = (1 << 64) - 1
    return [full & ~sum(0xFF << (8 * p) for p in free) for free in combinations(range(8), distance)]


def postings(members: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(position, key, fps, nodes) of the inverted index, for keys that two or more members share.

    `members` has different fp, each with its node.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in shared_byte_masks(distance)]
    keys = F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("position"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
        for i, m in enumerate(signed)
    ])
    grouped = (
        members.select("fp", "node", F.explode(keys).alias("k"))
        .groupBy("k.position", "k.key")
        .agg(F.collect_list(F.struct("fp", "node")).alias("found"))
    )
    return grouped.where(F.size("found") > 1).select(F.col("found.fp").alias("fps"), F.col("found.node").alias("nodes"))


def _masks(free: np.ndarray, distance: int) -> np.ndarray:
    bits = [np.uint64(1) << np.uint64(b) for b in range(64) if (int(free) >> b) & 1]
    return np.array([np.bitwise_or.reduce(c) for n in range(1, distance + 1) for c in combinations(bits, n)], np.uint64)


def linked_members(fps: np.ndarray, nodes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node linked to it) inside one posting; exact for links of the posting.

    Every member is looked up under each mask of up to `distance` bits, so the work is linear in the members.
    """
    order = np.argsort(fps)
    fps, nodes = fps[order], nodes[order]
    differ = np.bitwise_or.reduce(fps ^ fps[0])
    sides: list[tuple[np.ndarray, np.ndarray]] = []
    for mask in _masks(differ, distance):
        wanted = fps ^ mask
        at = np.minimum(np.searchsorted(fps, wanted), len(fps) - 1)
        hit = np.flatnonzero((fps[at] == wanted) & (fps < wanted))
        if len(hit):
            sides.append((hit, at[hit]))
    if not sides:
        return nodes[:0], nodes[:0]
    a, b = (np.concatenate(x) for x in zip(*sides, strict=True))
    label = nodes.copy()
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if np.array_equal(before, label):
            break
    moved = label != nodes
    return nodes[moved], label[moved]


def links(index: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Verified star edges (a, b) of all postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                linked_members(np.array(f, np.int64).view(np.uint64), np.array(n, np.int64), distance)
                for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            a, b = (np.concatenate([np.array([], np.int64), *x]) for x in zip(*found, strict=True)) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return index.mapInArrow(run, "a bigint, b bigint")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Texts that are null, empty or without a word share fingerprint zero and link like any other. Rows
    that repeat an id are one node of the graph. A row with a null id links nothing; it gets the
    component of its fingerprint, null if no other row has it. An empty table gives no rows. Only the
    two named columns are read; ids are integers.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    members = materialise(
        rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-members"
    )
    found = smallest_reachable(links(postings(members, distance), distance))
    placed = members.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    placed = materialise(placed, "fingerprint-components")
    return rows.join(placed, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
