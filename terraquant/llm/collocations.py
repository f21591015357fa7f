"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

A stripe is a prefix and the words that follow it, with counts: prefixes of no, one and two words give
the words, pairs and triples of a language as their extensions. A task counts its own stripes as arrays
of word numbers and packs them into blocks by bucket of prefixes, one row for each partition of the
shuffle; there the blocks of a bucket are merged elementwise, one bucket after the other. A prefix that many words
follow is dealt over the buckets by its followers.

A phrase that occurs `min_count` times has parts that occur as often, so the stripes of longer prefixes
leave out what a filter of fixed size over the frequent shorter phrases excludes. The filter has false
hits only; they cost time and are counted like the rest. From the merged stripes come the extensions
(phrases), the totals of prefixes (left sides) and the maxima over longer phrases (subsumption).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch
from .shared import filter_bits, in_filter, lower_arrow_batches

MIN_COUNT = 10
LONGEST = 3
TOP = 2000
SUBSUMED_PERCENT = 50
SCALE = 1_000_000
# Buckets of prefixes for each partition of a shuffle.
BUCKETS = 8
# A prefix is dealt by its followers from this share of all words on, so at most as many prefixes are.
HOT_SHARE = 1 / 1000
# Words a task counts before it hands its stripes on.
FLUSH = 4_000_000
# What ends a piece, as one mark; the mark is no word, since it separates words.
_MARKS = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
BLOCKS = "lang string, part int, prefixes array<binary>, sizes array<binary>, followers array<binary>, counts array<binary>"
# Rows of blocks in an Arrow batch; a memory bound.
BATCH = 125


def piece_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, with `.` where a piece ends."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_MARKS).replace(b".", b" . ").split()


class _Filter:
    """Whether a phrase of a language may be frequent."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def passes(self, lang: str, phrases: list[bytes]) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(phrases), bool)
        start = crc32(lang.encode() + b"\0")
        return in_filter(self.bits, np.array([crc32(p, start) for p in phrases], np.int64))


def _encoded(
    prefixes: list[bytes], lang: str, prefix_of: np.ndarray, follower: np.ndarray, counts: np.ndarray, words: list[bytes], hot: frozenset | None, buckets: int
):
    """Blocks of stripes from sorted (prefix, follower) numbers: a row for each part, with a block for each of its buckets.

    A stripe lies in the bucket of its prefix; one of a hot prefix (None: all are) is dealt by its followers.
    """
    if not len(prefix_of):
        return
    used = np.unique(prefix_of)
    start = np.zeros(len(prefixes), np.int64)
    start[used] = [crc32(prefixes[p]) for p in used.tolist()]
    is_hot = np.zeros(len(prefixes), bool)
    is_hot[used] = [hot is None or (lang, prefixes[p]) in hot for p in used.tolist()]
    bucket = start[prefix_of] % buckets
    dealt = np.flatnonzero(is_hot[prefix_of])
    bucket[dealt] = [crc32(words[w], s) % buckets for w, s in zip(follower[dealt].tolist(), start[prefix_of[dealt]].tolist(), strict=True)]
    order = np.argsort(bucket, kind="stable")
    bucket, prefix_of, counts = bucket[order], prefix_of[order], counts[order].astype("<u4")
    names = [words[w] for w in follower[order].tolist()]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows: dict[int, list[list[bytes]]] = {}
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(names)], strict=True):
        own = prefix_of[a:b]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[starts, b - a]).astype("<u4")
        part, at = divmod(int(bucket[a]), BUCKETS)
        row = rows.setdefault(part, [[b""] * BUCKETS for _ in range(4)])
        block = (b"\n".join([prefixes[p] for p in own[starts].tolist()]), sizes.tobytes(), b" ".join(names[a:b]), counts[a:b].tobytes())
        for column, value in zip(row, block, strict=True):
            column[at] = value
    columns = [pa.array(c, pa.list_(pa.binary())) for c in zip(*rows.values(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(rows)), pa.array(list(rows), pa.int32()), *columns], ["lang", "part", "prefixes", "sizes", "followers", "counts"]
    )


def _own_stripes(lang: str, tokens: np.ndarray, words: list[bytes], length: int, may: _Filter, hot: frozenset | None, buckets: int):
    """The stripes of one task and language for prefixes of `length` words; token -1 ends a piece."""
    if length == 0:
        follower, counts = np.unique(tokens[tokens >= 0], return_counts=True)
        yield from _encoded([b""], lang, np.zeros(len(follower), np.int64), follower, counts, words, hot, buckets)
        return
    if length == 1:
        known = may.passes(lang, words)
        fine = np.r_[known, False][tokens]
        at = np.flatnonzero(fine[:-1] & fine[1:])
        codes, counts = np.unique(tokens[at] << 32 | tokens[at + 1], return_counts=True)
        yield from _encoded(words, lang, codes >> 32, codes & 0xFFFFFFFF, counts, words, hot, buckets)
        return
    at = np.flatnonzero((tokens[:-1] >= 0) & (tokens[1:] >= 0))
    pairs, pair_of = np.unique(tokens[at] << 32 | tokens[at + 1], return_inverse=True)
    names = [words[a] + b" " + words[b] for a, b in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True)]
    here = np.full(len(tokens), -1)
    here[at] = np.where(may.passes(lang, names)[pair_of], pair_of, -1) if len(at) else -1
    at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
    codes, counts = np.unique(here[at] << 32 | tokens[at + 2], return_counts=True)
    yield from _encoded(names, lang, codes >> 32, codes & 0xFFFFFFFF, counts, words, hot, buckets)


def partial_stripes(docs: DataFrame, length: int, bits: np.ndarray | None, hot: frozenset | None, lang_col: str, text_col: str) -> DataFrame:
    """Blocks of stripes as the tasks count them, several for a prefix."""
    lower_arrow_batches(docs.sparkSession, BATCH)
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = docs.sparkSession.sparkContext.broadcast((bits, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        may, held, size = _Filter(bits), {}, 0
        number: dict[bytes, int] = {b".": -1}

        def flush():
            words = [w for w in number if w != b"."]
            for lang, arrays in held.items():
                tokens = np.concatenate(arrays)
                yield from _own_stripes(lang, tokens, words, length, may, hot, buckets)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = piece_words(text)
                words.append(b".")
                tokens = [number.setdefault(w, len(number) - 1) for w in words]
                held.setdefault(lang, []).append(np.array(tokens, np.int64))
                size += len(words)
                if size >= FLUSH:
                    yield from flush()
                    held, size, number = {}, 0, {b".": -1}
        yield from flush()

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, BLOCKS)


def _merged(blocks: list[tuple], min_count: int) -> tuple[list[bytes], list[bytes], np.ndarray, int]:
    """Elementwise sum of the stripes of one bucket: (prefix, follower, n) seen `min_count` times, and the total of the empty prefix."""
    prefix = pa.array([p for b in blocks for p in b[0].split(b"\n")], pa.binary()).dictionary_encode()
    follower = pa.array([w for b in blocks for w in b[2].split(b" ")], pa.binary()).dictionary_encode()
    sizes, counts = (np.frombuffer(b"".join([b[k] for b in blocks]), "<u4").astype(np.int64) for k in (1, 3))
    of = np.repeat(prefix.indices.to_numpy().astype(np.int64), sizes)
    names = len(follower.dictionary)
    both, where = np.unique(of * names + follower.indices.to_numpy(), return_inverse=True)
    sums = np.bincount(where, weights=counts).astype(np.int64)  # exact below 2^53
    keep = np.flatnonzero(sums >= min_count)
    taken = [side.dictionary.take(pa.array(at)).to_pylist() for side, at in ((prefix, both[keep] // names), (follower, both[keep] % names))]
    empty = [i for i, p in enumerate(prefix.dictionary.to_pylist()) if not p]
    return *taken, sums[keep], int(counts[np.isin(of, empty)].sum())


def merged_stripes(blocks: DataFrame, min_count: int) -> DataFrame:
    """(lang, prefix, follower, n): followers seen `min_count` times after a prefix; the empty prefix also has totals, without follower.

    A task holds the rows of a part and merges the blocks of one bucket after the other. Parts grow in number with the shuffle's
    partitions, and a prefix with many followers lies in many buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: tuple, held: list[tuple]) -> pa.RecordBatch:
            prefixes, followers, sums, total = _merged(held, min_count)
            columns = [[key[0]] * (len(sums) + 1), [*prefixes, b""], [*followers, None], [*sums.tolist(), total]]
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "prefix", "follower", "n"])

        def merged(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(BUCKETS):
                held = [tuple(column[at] for column in row) for row in rows if row[1][at]]
                if held:
                    yield told(key, held)

        last, held = None, []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, *block in zip(keys, *[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                if held and key != last:
                    yield from merged(last, held)
                    held = []
                last = key
                held.append(tuple(block))
        if held:
            yield from merged(last, held)

    keys = ["lang", "part"]
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "lang string, prefix binary, follower binary, n long")


def _phrase(prefix: Column, follower: Column) -> Column:
    return F.when(F.octet_length(prefix) == 0, follower).otherwise(F.concat(prefix, F.lit(b" "), follower))


def phrase_counts(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of phrases seen `min_count` times, and (lang, n) with all word occurrences."""
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words")
    bits, hot, found, sizes = None, None, [], None
    for length in range(longest):
        stripes = materialise(merged_stripes(partial_stripes(docs, length, bits, hot, lang_col, text_col), min_count), f"stripes-{length}")
        phrase = F.decode(_phrase(F.col("prefix"), F.col("follower")), "utf-8")
        found.append(stripes.where("follower is not null").select("lang", phrase.alias("phrase"), F.lit(length + 1).alias("length"), F.col("n").alias("f")))
        if not length:
            sizes = stripes.where("follower is null").groupBy("lang").agg(F.sum("n").alias("n"))
        if length + 1 < longest:
            bits = filter_bits(found[-1].select(F.crc32(F.concat("lang", F.lit("\0"), "phrase"))))
            words = sizes.agg(F.sum("n")).first()[0] or 0
            # At most 1 / HOT_SHARE phrases of a length can have that share of all words.
            top = found[-1].where(F.col("f") >= max(HOT_SHARE * words, 1.0)).select("lang", "phrase").collect()
            hot = frozenset((r["lang"], r["phrase"].encode()) for r in top)
    return reduce(DataFrame.unionByName, found), sizes


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    subsumed_percent: int = SUBSUMED_PERCENT,
    top: int | None = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of 2 to `longest` words of each language.

    Candidates occur `min_count` times or more inside pieces. A candidate's score is the lowest of its
    cuts, floor(1000000 a a / (l r)), ties to the earliest cut; sums are exact up to 10^16 occurrences.
    A candidate goes if a longer one holds its words and has `subsumed_percent` of its occurrences.
    Ranks are by score, a, then phrase in byte order. A null text is empty, a null language `und`, and a
    repeated row counts as often as it is given. Languages without a candidate, and an empty table, give
    no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    with scratch(spark):
        counts, sizes = phrase_counts(docs, lang_col, text_col, min_count, longest)
        counts = materialise(counts, "phrase-counts")
        words = F.split("phrase", " ", -1)
        several = counts.where("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), words.alias("w"))
        # Every shorter phrase of two words or more inside a candidate, with the most that such a candidate occurs.
        starts = lambda k: F.transform(F.sequence(F.lit(1), F.col("length") - k + 1), lambda i: _joined(F.col("w"), i, k))
        inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), starts))
        longer = several.where("length > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        left = several.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < subsumed_percent * F.col("a"), F.lit(True)))
        cuts = left.select("lang", "phrase", "length", "a", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
        cuts = cuts.select(
            "lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), _joined(F.col("w"), F.col("k") + 1, F.col("length")).alias("rest")
        )
        sides = [counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("first", "l"), ("rest", "r"))]
        scored = cuts.join(sides[0], ["lang", "first"]).join(sides[1], ["lang", "rest"])
        a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
        scored = scored.withColumns({"up": a * a * F.lit(SCALE).cast("decimal(7,0)"), "down": l * r}).withColumn("score", F.expr("up div down"))
        best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
        best = best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
        ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
        return materialise(ranked.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)
