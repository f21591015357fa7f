"""Artefact files: CSV with a byte-order mark, model metadata, result bundles, manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("chosen_run", T.IntegerType()),
        T.StructField("random_state", T.IntegerType()),
        T.StructField("split", T.StructType([T.StructField("train", T.DoubleType()), T.StructField("test", T.DoubleType())])),
        T.StructField("cv", T.IntegerType()),
        T.StructField(
            "metrics",
            T.StructType([T.StructField(m, T.DoubleType()) for m in ("test_R2", "test_MAE", "test_RMSE")]),
        ),
        T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("selected_features", T.ArrayType(T.StringType())),
        T.StructField("target", T.StringType()),
        T.StructField(
            "clip_quantiles",
            T.StructType([T.StructField("low_0.01", T.DoubleType()), T.StructField("high_0.99", T.DoubleType())]),
        ),
    ]
)


def write_csv_with_bom(df: DataFrame, path: str) -> None:
    """Write CSV parts whose header starts with a UTF-8 byte-order mark."""
    first, *rest = df.columns
    df.select(F.col(first).alias(BOM + first), *rest).write.mode("overwrite").option("header", True).csv(path)


def read_csv_with_bom(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Read CSV text columns by an explicit header, byte-order mark or not.

    Columns come back as text; nothing is inferred, so no extra pass is made. The
    reader itself drops a byte-order mark at the start of each part.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def numeric_column(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """One text column as doubles; text that is not a number, and NaN, are dropped."""
    value = F.nanvl(F.expr(f"try_cast(`{column}` AS DOUBLE)"), F.lit(None).cast("double"))
    return df.select(*keep, value.alias(column)).where(F.col(column).isNotNull())


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(path)


def write_bundle(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write named result tables as one bundle, a Parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a folder, read as binary by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", content_hash("content").alias("sha256"))


def content_hash(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def check_manifest(actual: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """Compare content hashes with a manifest: ok, mismatch, or missing."""
    joined = manifest.select(name, F.col("sha256").alias("expected")).join(
        actual.select(name, F.col("sha256").alias("actual")), name, "left"
    )
    status = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("expected"), "ok").otherwise("mismatch")
    )
    return joined.withColumn("status", status)
