"""Exact order statistics without a global sort.

``exact_quantiles`` brackets each wanted rank with a bounded sketch and settles it
by counting. ``hash_order_cutoffs`` finds the
k-th row of a hash order by counting hash prefixes, two tiny histograms and one
look inside a 1/16.7M slice. Both move only counts between executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .hashing import digest

SKETCH_ACCURACY = 4_000
PREFIX_DIGITS = 3


@dataclass
class _Search:
    """Where the value at one 0-based rank is known to lie, and the bracket to try next."""

    rank: int
    low: float
    high: float
    below: int
    inside: int
    slack: float
    bracket: tuple[float, float]

    def share(self) -> float:
        return (self.rank - self.below) / max(self.inside - 1, 1)

    def fits(self, direct_rows: int) -> bool:
        """Whether the bracket's interior may be fetched: its expected size is the sketched share of the span."""
        return self.inside * min(1.0, 3 * self.slack) <= direct_rows


def _interior(ends: list[float], bracket: tuple[float, float]) -> list[int]:
    """Pieces strictly between a bracket's ends that hold no end themselves."""
    first, last = ends.index(bracket[0]), ends.index(bracket[1])
    return [2 * i + 2 for i in range(first, last)]


def _around(share: float, slack: float) -> list[float]:
    return [max(0.0, share - slack), min(1.0, share + slack)]


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], direct_rows: int = 500_000
) -> tuple[list[float | None], int]:
    """Linear-interpolated quantiles of a column over the whole table, and its non-null count.

    A bounded sketch names a narrow bracket around each wanted rank; the next pass
    counts what lies below it and brings the few values strictly inside. Counts
    decide, so a sketch that missed only costs another round. A bracket that would
    hold too many values is sketched again within (three orders of magnitude per
    round, whatever the distribution); repeated values sit on a bracket's edges and
    are only counted.
    """
    y = F.col("y")
    values = df.select(F.col(column).cast("double").alias("y")).where(y.isNotNull())
    base = 2.0 / SKETCH_ACCURACY
    first = values.agg(
        F.count("y").alias("n"),
        F.min("y").alias("low"),
        F.max("y").alias("high"),
        F.percentile_approx("y", [x for p in probs for x in _around(p, base)], SKETCH_ACCURACY).alias("sketch"),
    ).first()
    n = first["n"]
    if n == 0:
        return [None] * len(probs), 0
    positions = [p * (n - 1) for p in probs]
    searches = {
        r: _Search(r, first["low"], first["high"], 0, n, base, tuple(first["sketch"][2 * i : 2 * i + 2]))
        for i, pos in enumerate(positions)
        for r in (math.floor(pos), math.ceil(pos))
    }
    found: dict[int, float] = {}
    while searches:
        # The brackets' ends cut the line into pieces: even ones between ends, odd ones an end itself.
        ends = sorted({e for s in searches.values() for e in s.bracket})
        piece = sum(((y >= e).cast("int") + (y > e).cast("int") for e in ends), F.lit(0))
        wanted = {i for s in searches.values() if s.fits(direct_rows) for i in _interior(ends, s.bracket)}
        kept = F.when(F.col("piece").isin(sorted(wanted)), y) if wanted else F.lit(None).cast("double")
        rows = (
            values.select("y", piece.alias("piece"))
            .groupBy("piece", kept.alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        size = [0] * (2 * len(ends) + 1)
        held: dict[int, list[tuple[float, int]]] = {}
        for r in sorted(rows, key=lambda r: (r["piece"], r["value"] if r["value"] is not None else 0.0)):
            size[r["piece"]] += r["n"]
            held.setdefault(r["piece"], []).append((r["value"], r["n"]))
        before = list(accumulate(size, initial=0))
        for s in list(searches.values()):
            at = next(i for i in range(len(size)) if s.rank < before[i + 1])
            if at % 2:
                found[s.rank] = ends[at // 2]
            elif at in wanted:
                passed = list(accumulate((c for _, c in held[at]), initial=before[at]))
                found[s.rank] = next(v for (v, _), upto in zip(held[at], passed[1:], strict=True) if s.rank < upto)
            elif at in _interior(ends, s.bracket):
                s.low, s.high, s.slack = ends[at // 2 - 1], ends[at // 2], base
                s.below, s.inside = before[at - 1], size[at - 1] + size[at] + size[at + 1]
            else:
                s.slack *= 4
        searches = {r: s for r, s in searches.items() if r not in found}
        if searches:
            row = values.agg(
                *[
                    F.percentile_approx(F.when(y.between(s.low, s.high), y), _around(s.share(), s.slack), SKETCH_ACCURACY).alias(f"s{r}")
                    for r, s in searches.items()
                ]
            ).first()
            for r, s in searches.items():
                s.bracket = tuple(row[f"s{r}"])
    out = []
    for pos in positions:
        low, high = found[math.floor(pos)], found[math.ceil(pos)]
        out.append(low + (high - low) * (pos - math.floor(pos)))
    return out, n


def order_struct(tag: str, key: str, tiebreak: Sequence[str] = ()) -> Column:
    """The total order used for seeded shuffles: hash, then key, then tie-breaks."""
    return F.struct(digest(tag, key).alias("h"), F.col(key).alias("k"), *[F.col(c) for c in tiebreak])


def hash_order_cutoffs(df: DataFrame, tag: str, key: str, tiebreak: Sequence[str], ranks) -> DataFrame:
    """Rows of the hash order at given 1-based ranks, as one row ``(cuts array<struct>, n)``.

    ``ranks`` maps the row-count column to a list of rank columns. The row count,
    the prefix histograms and the final slice are separate small aggregates of the
    same scan; nothing wider than a key is shuffled.
    """
    rows = df.select(order_struct(tag, key, tiebreak).alias("o"))
    rows = rows.select(
        "o",
        F.substring("o.h", 1, PREFIX_DIGITS).alias("p1"),
        F.substring("o.h", 1 + PREFIX_DIGITS, PREFIX_DIGITS).alias("p2"),
    )
    histogram = rows.groupBy("p1").agg(F.count(F.lit(1)).alias("c"))
    running = Window.orderBy("p1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level1 = histogram.select(
        "p1",
        F.sum("c").over(running).alias("upto"),
        "c",
        F.sum("c").over(Window.partitionBy()).alias("n"),
    )
    wanted = level1.select(
        "p1", "n", (F.col("upto") - F.col("c")).alias("before"), "upto", F.posexplode(F.array(*ranks(F.col("n")))).alias("cut", "rank")
    ).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
    wanted = wanted.select("cut", "n", "p1", (F.col("rank") - F.col("before")).alias("need"))
    inner = Window.partitionBy("cut").orderBy("p2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level2 = (
        rows.join(F.broadcast(wanted), "p1")
        .groupBy("cut", "n", "p1", "need", "p2")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("upto", F.sum("c").over(inner))
        .where((F.col("need") > F.col("upto") - F.col("c")) & (F.col("need") <= F.col("upto")))
        .select("cut", "n", "p1", "p2", (F.col("need") - F.col("upto") + F.col("c")).alias("need"))
    )
    slice_order = Window.partitionBy("cut").orderBy("o")
    return (
        rows.join(F.broadcast(level2), ["p1", "p2"])
        .withColumn("rn", F.row_number().over(slice_order))
        .where(F.col("rn") == F.col("need"))
        .agg(F.array_sort(F.collect_list(F.struct("cut", "o"))).alias("cuts"), F.max("n").alias("n"))
        .select(F.transform("cuts", lambda c: c["o"]).alias("cuts"), "n")
    )


def hash_order_index(df: DataFrame, tag: str, key: str, tiebreak: Sequence[str] = (), index: str = "idx") -> DataFrame:
    """Add the 0-based position of every row in the hash order.

    Positions are an offset per hash prefix (4096 counts) plus a row number inside
    the prefix, so the sort runs on 4096 even slices instead of one.
    """
    keyed = df.select("*", digest(tag, key).alias("__h")).select(
        "*", F.substring("__h", 1, PREFIX_DIGITS).alias("__p")
    )
    offsets = keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    running = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = offsets.select("__p", (F.sum("c").over(running) - F.col("c")).alias("__offset"))
    inside = Window.partitionBy("__p").orderBy("__h", key, *tiebreak)
    return (
        keyed.withColumn("__rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__p")
        .select(*df.columns, (F.col("__offset") + F.col("__rn") - 1).cast("bigint").alias(index))
    )


def value_order_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """Global 1-based rank of every row of a large table.

    The table is range-partitioned on the whole order (so equal leading values are
    split by the tie-breaks), each row's place is read off the sorted partition, and
    partition offsets come from a small count. The sorted table is written to the
    shared folder because the offsets and the ranks must see the same partitions.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .select("*", F.monotonically_increasing_id().alias("__id"))
        .select(
            *df.columns,
            F.shiftright("__id", 33).alias("__part"),
            F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"),
        )
    )
    placed = materialise(placed, "ranked")
    running = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("c"))
    offsets = offsets.select("__part", (F.sum("c").over(running) - F.col("c")).alias("__offset"))
    return placed.join(F.broadcast(offsets), "__part").select(
        *df.columns, (F.col("__offset") + F.col("__pos") + 1).cast("bigint").alias(rank)
    )
