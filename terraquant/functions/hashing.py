"""Keyed-hash randomness.

Every random choice is a function of a tag and the row's declared key, so it does
not depend on partitioning, retries or row order. One md5 digest carries four
32-bit draws; seeds are packed four to a digest.
"""

from __future__ import annotations

import binascii
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = 2**32
DRAWS_PER_DIGEST = 4


def digest(tag: Column | str, key: Column | str) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(tag.cast("string"), F.lit(":"), key.cast("string")))


def hex_draw(digest_col: Column, lane: int) -> Column:
    """Draw number ``lane`` of a digest as eight hex digits."""
    return F.substring(digest_col, 1 + 8 * lane, 8)


def bits_of(hex_col: Column) -> Column:
    return F.conv(hex_col, 16, 10).cast("bigint")


def seed_hex(seed: int, key: Column | str) -> Column:
    block, lane = divmod(seed, DRAWS_PER_DIGEST)
    return hex_draw(digest(str(block), key), lane)


def seed_bits(seed: int, key: Column | str) -> Column:
    return bits_of(seed_hex(seed, key))


def tagged_bits(tag: Column | str, key: Column | str) -> Column:
    return bits_of(hex_draw(digest(tag, key), 0))


def below(hex_col: Column, fraction: float) -> Column:
    """``draw / 2**32 < fraction`` decided on the hex text, without a base conversion."""
    least = draws_below(fraction)
    return hex_col <= F.lit(f"{least - 1:08x}") if least else F.lit(False)


def draws_below(fraction: float) -> int:
    """The number of 32-bit draws that lie below a fraction."""
    return min(max(math.ceil(fraction * SPACE), 0), SPACE)


def with_seed_draws(df: DataFrame, seeds: int, key: str, column: str = "draw", seed: str = "seed") -> DataFrame:
    """One row per (row, seed) with that seed's draw as hex text.

    Digests are computed once per four seeds and unpacked by a second explode; no
    join and no shuffle.
    """
    blocks = -(-seeds // DRAWS_PER_DIGEST)
    hashed = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")).select(
        "*", digest(F.col("__block"), key).alias("__digest")
    )
    lanes = F.array(
        *[
            F.struct(
                (F.col("__block") * DRAWS_PER_DIGEST + lane).cast("int").alias("seed"),
                hex_draw(F.col("__digest"), lane).alias("draw"),
            )
            for lane in range(DRAWS_PER_DIGEST)
        ]
    )
    wide = hashed.select("*", F.explode(lanes).alias("__lane")).select(
        *df.columns, F.col("__lane.seed").alias(seed), F.col("__lane.draw").alias(column)
    )
    return wide if seeds % DRAWS_PER_DIGEST == 0 else wide.where(F.col(seed) < seeds)


def permutation_rows(items: list[str], count: int, tag: str) -> list[list[str]]:
    """``count`` seeded permutations of a short list, for plans that need literals."""
    import hashlib

    def order(i: int, item: str) -> str:
        return hashlib.md5(f"{tag}:{i}:{item}".encode()).hexdigest()

    return [sorted(items, key=lambda item: order(i, item)) for i in range(count)]


def seed_draws(df: DataFrame, seeds: int, key: str, column: str = "draws") -> DataFrame:
    """Add an array with the draw (hex text) of every seed, the draws of ``with_seed_draws`` without its rows."""
    blocks = -(-seeds // DRAWS_PER_DIGEST)
    hashed = df.select("*", F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: digest(b, key)).alias("__digests"))
    drawn = F.flatten(F.transform("__digests", lambda d: F.array(*[hex_draw(d, lane) for lane in range(DRAWS_PER_DIGEST)])))
    return hashed.select(*df.columns, F.slice(drawn, 1, seeds).alias(column))


def numbered_draws(key: str, count: int, tag: str) -> Column:
    """An array with draws number 0 to count - 1 of a tag: lane i % 4 of the digest of (tag, i // 4)."""
    blocks = -(-count // DRAWS_PER_DIGEST)
    digests = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: digest(F.concat(F.lit(tag), b.cast("string")), key))
    return F.slice(F.flatten(F.transform(digests, lambda d: F.array(*[bits_of(hex_draw(d, lane)) for lane in range(DRAWS_PER_DIGEST)]))), 1, count)


@dataclass(frozen=True)
class Drawn:
    """The first `count` draws of a key as text, eight hex digits each; a draw below `limit` is a test row."""

    text: Column
    count: int
    limit: int = 0


def drawn_text(key: Column | str, count: int, tag: str = "") -> Column:
    """The digests with draws 0 to count - 1 of a tag in a row, eight hex digits a draw; null for a null key.

    Without a tag these are the draws of ``seed_draws``, else those of ``numbered_draws``. Workers
    read the text by ``unpacked_draws``, which costs less than expressions for single draws.
    """
    return F.concat(*[digest(f"{tag}{b}", key) for b in range(-(-count // DRAWS_PER_DIGEST))])


def unpacked_draws(text: pa.Array, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x draws as 32-bit numbers, and which rows have any."""
    known = text.is_valid().to_numpy(zero_copy_only=False)
    width = 8 * DRAWS_PER_DIGEST * -(-count // DRAWS_PER_DIGEST)
    if text.null_count:
        text = text.fill_null("0" * width)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    raw = binascii.unhexlify(memoryview(text.buffers()[2])[ends[0] : ends[-1]])
    return np.frombuffer(raw, ">u4").reshape(len(text), -1)[:, :count].astype(np.uint32), known
