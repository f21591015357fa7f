"""Target-distribution importance resampling: hashed n-gram weights by array, then a distributed quickselect.

Every run of one or two words falls into one of `BUCKETS` buckets. Two tables of counters of that
fixed size, one of the corpus and one of the target texts, give each bucket a gain; a document's
weight is the floored mean of the gains that its features look up in one array. A keyed draw is added
to the weight (Gumbel's distribution, so the highest scores are a weighted sample without
replacement). The k-th composite key is then found by rounds of random pivots, drawn from the rows
still in question: exact counts below, at and above every pivot narrow the range, until one key is
left. Only the winners are sorted and ranked, over range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_stats import value_order_rank
from ..session import materialise, scratch
from .shared import lower_arrow_batches

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
PIVOTS = 31
# A-Z become lower case; letters, digits and all of UTF-8's other bytes stay, the rest separates words.
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
# The order of the draw: score down, id up; then what tells rows of one id apart.
ORDER = ("score_", "doc_id", "weight_", "features_")


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The bucket of every run of one or two words of a text, repeats included, and its number of words."""
    from zlib import crc32

    words = (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()
    single = [crc32(w) for w in words]
    # A checksum can be carried on: that of a pair starts from that of its first word and a blank.
    pairs = [crc32(w, crc32(b" ", c)) for c, w in zip(single, words[1:], strict=False)]
    return np.array(single + pairs, np.int64) % buckets, len(words)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket; `buckets` numbers reach the driver, whatever the input."""
    lower_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(feature_buckets(text, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares of each bucket, target against corpus, floored."""
    import math

    s_all, t_all, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array(
        [
            math.floor(1000 * math.log((int(t) + 1) * (s_all + b) / ((int(s) + 1) * (t_all + b))))
            for s, t in zip(corpus, target, strict=True)
        ],
        np.int64,
    )


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight of every row; no feature weighs 0."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            told = []
            for text in batch.column(1).to_pylist():
                at, words = feature_buckets(text, len(gain))
                told.append((len(at), words, int(gain[at].sum()) // max(len(at), 1)))
            columns = np.array(told, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns.T]], ["doc_id", "n_features", "n_words", "weight"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def draw_score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """Weight plus thousandths of a keyed Gumbel draw, floored. A null id draws as the text `null`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _key(df: DataFrame) -> DataFrame:
    """Adds `key`, the composite key in ascending order of the draw; null ids come last among equal scores."""
    return df.withColumn(
        "key", F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), (-F.col("weight")).alias("d"),
                        (-F.col("n_features")).alias("e"))
    )


def _literal(key) -> Column:
    names = [F.lit(v).cast("boolean" if i == 1 else "long").alias(n) for i, (n, v) in enumerate(key.asDict().items())]
    return F.struct(*names)


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS):
    """The k-th smallest `key` (1-based), by rounds of random pivots and exact three-way counts.

    A round costs a bounded top-n of hashes, which draws the pivots, and one count of the pieces that
    they cut the range into: odd pieces are a pivot itself. With 31 pivots a round leaves about a
    sixteenth of the rows, or ends at once on a pivot that holds the k-th key.
    """
    low = high = None
    turn = 0
    while True:
        inside = rows if low is None else rows.where(F.col("key") > _literal(low))
        inside = inside if high is None else inside.where(F.col("key") < _literal(high))
        drawn = inside.select("key", F.xxhash64(F.lit(turn), "key").alias("h")).orderBy("h", "key").limit(pivots).select("key").collect()
        ends = sorted({tuple(r["key"]): r["key"] for r in drawn}.items(), key=lambda e: tuple((v is None, v) for v in e[0]))
        ends = [key for _, key in ends]
        piece = reduce(lambda a, b: a + b, [(F.col("key") >= _literal(e)).cast("int") + (F.col("key") > _literal(e)).cast("int") for e in ends])
        counts = {r["piece"]: r["count"] for r in inside.groupBy(piece.alias("piece")).count().collect()}
        at = -1
        while k > 0:
            at += 1
            k -= counts.get(at, 0)
        k += counts[at]
        if at % 2:
            return ends[at // 2]
        low, high = ends[at // 2 - 1] if at else low, ends[at // 2] if at // 2 < len(ends) else high
        turn += 1


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (1, 2, ... of the drawn, null for the rest).

    Of the N rows with `min_words` words or more, the floor(percent N / 100) highest scores are drawn,
    ties to the smaller doc_id, then to weight and number of features; of wholly equal rows any. A null
    text has no features and weight 0. A null id comes last among equal scores. An empty table, or a
    draw of none, gives rows without rank; an empty target is one without features. Only the named
    columns are read; ids are integers.
    """
    spark = docs.sparkSession
    with scratch(spark):
        gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
        scored = weights(docs, gain, id_col, text_col).withColumn("score", draw_score(F.col("weight"), F.col("doc_id"), seed))
        scored = materialise(scored, "importance-scored", keep=True)
        keyed = _key(scored.where(F.col("n_words") >= min_words))
        k = percent * keyed.count() // 100
        out = ["doc_id", "n_features", "weight", "score"]
        if k == 0:
            return scored.select(*out, F.lit(None).cast("long").alias("rank"))
        last = _literal(kth_key(keyed, k))
        winner = (F.col("n_words") >= min_words) & (F.col("key") <= last)
        won = value_order_rank(materialise(_key(scored).where(winner), "importance-winners"), [F.asc("key")], "rank")
        won = materialise(won, "importance-ranked", keep=True)
    # Rows that equal the last winner in everything may be more than there are places.
    rank = F.when(F.col("rank") <= k, F.col("rank"))
    rest = _key(scored).where(~winner).select(*out, F.lit(None).cast("long").alias("rank"))
    return won.select(*out, rank.alias("rank")).unionByName(rest)
