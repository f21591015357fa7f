"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "terraquant") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "terraquant-shared")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/terraquant/{label}-{uuid.uuid4().hex}"


# Scopes that are open, innermost last; each lists the tables written in it.
_SCOPES: list[list[str]] = []


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; used where one
    prepared table feeds many jobs (tree growing, grid search). A scope that is
    open lists the table, or with `keep` the scope around it does.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of the shared folder; only for tables that no plan still to be run reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables written inside, for the caller to release once nothing reads them."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        # By identity: lists without a path yet are equal to each other.
        del _SCOPES[next(i for i, s in enumerate(_SCOPES) if s is made)]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside, but for kept ones, when the block ends.

    What leaves the block must be written with `keep`, so that its tables are complete before their
    inputs go, or be values; until then a lost executor finds every input again.
    """
    with recorded() as made:
        yield
    release(spark, made)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan that has fewer splits than the session has cores.

    A scan with enough splits (any large table) is returned untouched, so this
    costs a shuffle only where the input is too small to fill the cores. Must be
    called on a plain scan: the split count is read from its physical plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
