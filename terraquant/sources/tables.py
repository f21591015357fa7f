"""The given tables and the observation view built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import spread

KEY = "obs_key"
TIEBREAK = "tiebreak"
LABEL = "y"
FEATURES = ["x_qty", "x_disc", "x_size"]
ALL_FEATURES = ["x_qty", "x_disc", "x_total", "x_size", "x_price", "x_tax", "x_cust", "x_supp"]

# Dimension tables each observation column needs beyond the line items.
_NEEDS = {
    "place": ("orders", "customer", "nation"),
    "scenario": ("orders", "customer"),
    "x_total": ("orders",),
    "x_size": ("part",),
    "x_price": ("part",),
    "x_cust": ("orders", "customer"),
    "x_supp": ("supplier",),
    "y": ("part",),
}
_EXPR = {
    "obs_key": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "tiebreak": "l_extendedprice",
    "place": "n_name",
    "scenario": "c_mktsegment",
    "x_qty": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END",
    "x_disc": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount + 0.0D END",
    "x_total": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END",
    "x_size": "CAST(p_size AS DOUBLE)",
    "x_price": "p_retailprice",
    "x_tax": "l_tax",
    "x_cust": "c_acctbal",
    "x_supp": "s_acctbal",
    "y": "log10(l_quantity * p_retailprice * (1 - l_discount))",
}
_LINE_COLUMNS = {
    "obs_key": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "tiebreak": ("l_extendedprice",),
    "x_qty": ("l_orderkey", "l_quantity"),
    "x_disc": ("l_partkey", "l_discount"),
    "x_tax": ("l_tax",),
    "y": ("l_quantity", "l_discount"),
}
_LINE_KEY = {"orders": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is inferred once, so later reads start no inference job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def observations(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per line item: key, labels, features with gaps, and a log10 target.

    Dimension tables are joined only for the columns asked for; each is keyed by its
    primary key and every line item has its match, so the row set is the same. No
    join is hinted: the optimiser broadcasts a dimension while it is small, and
    adaptive execution splits a hot key when it is not. Rows that carry their key are
    about to be hashed or expanded, so a scan too small to fill the cores is spread.
    """
    columns = list(columns or _EXPR)
    needed = {t for c in columns for t in _NEEDS.get(c, ())}
    line_columns = {lc for c in columns for lc in _LINE_COLUMNS.get(c, ())} | {_LINE_KEY[t] for t in needed if t in _LINE_KEY}
    line_columns |= {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"} if not line_columns else set()
    ordered = sorted(line_columns)
    df = table(spark, sf_dir, "lineitem").select(*ordered)
    if KEY in columns:
        df = spread(df, *ordered)
    if "part" in needed:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "orders" in needed:
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "customer" in needed:
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if "nation" in needed:
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if "supplier" in needed:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return df.select(*[F.expr(_EXPR[c]).alias(c) for c in columns])
