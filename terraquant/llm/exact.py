"""Exact copies by a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (the merging form of Misra and Gries' counters) names the digests that may
hold a large part of all rows. Their groups are verified by exact counts, and the winners, a table of
bounded size, are broadcast: rows of large groups are judged where they lie. What remains has no
group above about 3.5 / `tracked` of all rows and takes an ordinary shuffle of ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch
from .shared import ascii_lower, keep_rows

TRACKED = 4096
HEAVY = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and SHA-256 of each text after lower-casing A-Z; null counts as empty."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def heavy_winners(rows: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """Verified (digest, keep_id, group_size) of at most `heavy` frequent digests.

    Sketches are merged in two steps, so no task reads the sketch of every other task.
    """
    sketches = (
        rows.select(F.xxhash64("digest").alias("h"), (F.spark_partition_id() % 32).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("state"))
        # Grouped by a constant: an ungrouped merge fails on partitions without rows.
        .groupBy(F.lit("all"))
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {tracked}), {heavy})").alias("top"))
    )
    candidates = sketches.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))
    return _groups(rows.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("h"), "left_semi"))


def flag_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, heavy: int = HEAVY
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays. Null and empty texts are equal to each other. A null id is
    smaller than any other; a group of null ids only keeps all its rows. Rows that repeat both id and
    text are one document and are flagged alike (`drop_copies` returns it once). An empty table gives
    no rows. Only the two named columns are read.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    winners = materialise(heavy_winners(rows, tracked, heavy), "heavy-digests").withColumn("heavy", F.lit(True))
    tagged = rows.join(F.broadcast(winners), "digest", "left")
    large = tagged.where("heavy").drop("heavy")
    rest = tagged.where("heavy is null").select("doc_id", "digest")
    flagged = large.unionByName(rest.join(_groups(rest), "digest"))
    return flagged.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with their own columns; a repeated row is returned once."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    with scratch(docs.sparkSession):
        flags = flag_copies(docs, id_col, text_col, **options)
        verdicts = flags.select("doc_id", F.unhex("text_sha256").alias("digest"), "kept")
        return keep_rows(docs, [F.col(id_col), F.unhex(F.sha2(text, 256))], verdicts)
