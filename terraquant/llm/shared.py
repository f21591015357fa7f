"""Column expressions and table access that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# What separates words in every contract of this folder: blank, tab and the line and form controls.
SEPARATORS = r"[\x20\x09-\x0D]+"
PY_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Text of one byte a character takes the cheap way to the same result."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column) -> Column:
    return F.array_remove(F.split(col, SEPARATORS), "")


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold rule of the learned operators."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def lower_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh_names(columns: Sequence[str], *names: str) -> list[str]:
    """The given names, lengthened until no column has them (Spark does not tell upper from lower case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# Bits of a filter over hashes: 2 MB, whatever the input. A full filter costs time, never rows.
FILTER_BITS = 1 << 24
_CHUNK_BITS = 1 << 15


def filter_bits(hashes: DataFrame) -> np.ndarray:
    """A filter over the hashes (a column of longs or smaller) as `FILTER_BITS` bits: false hits, no false misses."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS)).cast("long")
    chunks = hashes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _CHUNK_BITS).alias("chunk")).agg(
        F.bitmap_construct_agg(F.col("bit") % _CHUNK_BITS).alias("bits")
    )
    out = np.zeros((FILTER_BITS // _CHUNK_BITS, _CHUNK_BITS // 8), np.uint8)
    for r in chunks.collect():
        out[r["chunk"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def filter_table(hashes: DataFrame) -> DataFrame:
    """The same filter as a table (chunk, bits) of 512 longs a row and at most 512 rows."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS)).cast("long")
    words = hashes.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    held = words.groupBy(F.floor(F.col("word") / 512).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word") % 512, "bits"))).alias("m"))
    return held.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("bits"))


def split_by_filter(docs: DataFrame, hashed: Column, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash cannot be among those of the filter table, rows whose hash may be), each row in one of them.

    The table is a broadcast of 2 MB at most; no row of `docs` moves.
    """
    bit, chunk, bits = fresh_names(docs.columns, "filter_bit", "filter_chunk", "filter_bits")
    at = F.col(bit)
    marked = docs.withColumn(bit, F.pmod(hashed, F.lit(FILTER_BITS)).cast("long"))
    met = marked.join(F.broadcast(table.toDF(chunk, bits)), F.floor(at / (64 * 512)) == F.col(chunk), "left")
    word = F.get(F.col(bits), (F.floor(at / 64) % 512).cast("int"))
    hit = F.coalesce(F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return met.where(~hit).select(docs.columns), met.where(hit).select(docs.columns)


def keep_rows(docs: DataFrame, key: Sequence[Column], verdicts: DataFrame) -> DataFrame:
    """The rows of `docs` whose verdict is to stay, once each, with their own columns.

    `verdicts` has the key of every row, the id first, and then `kept`. Whole texts are moved only for
    rows whose id may be that of a row that goes or repeats; a filter of fixed size decides that where
    they lie.
    """
    parts = verdicts.columns[:-1]
    counted = verdicts.groupBy(*parts).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    special = materialise(counted.where(~F.col("kept") | (F.col("copies") > 1)), "special-rows", keep=True)
    table = materialise(filter_table(special.select(F.xxhash64(parts[0]))), "special-filter", keep=True)
    names = fresh_names(docs.columns, *[f"own_{p}" for p in parts])
    calm, suspect = split_by_filter(docs, F.xxhash64(key[0]), table)
    marked = suspect.select("*", *[k.alias(n) for k, n in zip(key, names, strict=True)])

    def with_key(table: DataFrame, how: str) -> DataFrame:
        other = table.select(*[F.col(p).alias(f"its_{n}") for p, n in zip(parts, names, strict=True)])
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"its_{n}")) for n in names])
        return marked.join(other, same, how)

    out = calm.unionByName(with_key(special, "left_anti").drop(*names))
    repeated = special.where("kept")
    if not repeated.isEmpty():
        out = out.unionByName(with_key(repeated, "left_semi").dropDuplicates(names).drop(*names))
    return out
