"""Exact attribution of tree models from their leaf paths.

A tree's expectation for a set S of known features follows the row at nodes whose feature is in S and
weighs both children by their training rows elsewhere. For one leaf that is a product over the
features of its path: 1 or 0 for a known feature (the row meets all of its conditions or not), and
the share of rows that pass its nodes for an unknown one. The Shapley values of such a product depend
only on which of the path's features are met, so they are tabled for every leaf and set of met
features; a row looks its sets up leaf by leaf. Values sum to prediction minus expectation exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .growth import Model, Rows, Tree, bin_code, list_matrix

LEAVES = "rep int, held int, cell int, tree int, leaf int, value double, share double, feature string, low double, high double, pass_share double"


@dataclass
class Leaf:
    """A leaf's value and, per feature of its path, the slots it takes (low < slot <= high) and the share of rows that pass."""

    node: int
    value: float
    features: list[int]
    low: list[int]
    high: list[int]
    share: list[float]


def leaves(tree: Tree, depth: int | None = None) -> list[Leaf]:
    """The leaf paths of a tree, or of its upper `depth` levels, with the conditions on each feature merged."""
    out, value = [], tree.value()
    for node in range(len(tree.feature)):
        level = tree.depth(node)
        if level > (level if depth is None else depth) or (tree.feature[node] >= 0 and level != depth):
            continue
        low: dict[int, int] = {}
        high: dict[int, int] = {}
        share: dict[int, float] = {}
        at = node
        while tree.parent[at] >= 0:
            up = tree.parent[at]
            f, slot = tree.feature[up], tree.slot[up]
            if at == tree.left[up]:
                high[f] = min(high.get(f, slot), slot)
            else:
                low[f] = max(low.get(f, slot), slot)
            share[f] = share.get(f, 1.0) * (tree.n[at] / tree.n[up] if tree.n[up] else 0.0)
            at = up
        own = sorted(share)
        out.append(Leaf(node, float(value[node]), own, [low.get(f, -1) for f in own], [high.get(f, 1 << 30) for f in own], [share[f] for f in own]))
    return out


def weights(leaf: Leaf) -> np.ndarray:
    """(2^k, k) Shapley values of a leaf's features for every set of met features (bit i: feature i is met)."""
    k = len(leaf.features)
    out = np.zeros((1 << k, k))
    for met in range(1 << k):
        for i in range(k):
            # Sum over sizes of known sets: only met features keep the product, unknown ones weigh their share.
            poly = np.array([1.0])
            for j in range(k):
                if j != i:
                    poly = np.append(poly * leaf.share[j], 0.0) + (np.append(0.0, poly) if met >> j & 1 else 0.0)
            sizes = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)])
            out[met, i] = leaf.value * ((met >> i & 1) - leaf.share[i]) * float(poly @ sizes)
    return out


def expectation(leaf_list: Sequence[Leaf]) -> float:
    return sum(leaf.value * float(np.prod(leaf.share)) for leaf in leaf_list)


def _tables(model: Model) -> tuple[list[tuple], float]:
    scale = model.rate if model.start is not None else 1.0 / len(model.trees)
    tables, base = [], model.start or 0.0
    for tree in model.trees:
        own = leaves(tree, model.depth)
        base += scale * expectation(own)
        for leaf in own:
            if leaf.features:
                bits = 1 << np.arange(len(leaf.features))
                tables.append((np.array(leaf.features), np.array(leaf.low)[:, None], np.array(leaf.high)[:, None], bits, scale * weights(leaf)))
    return tables, base


def attribute_codes(model: Model, codes: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Shapley values (rows x features) of rows of placed codes (features x rows), and the expectation."""
    tables, base = _tables(model)
    out = np.zeros((codes.shape[1], n_features))
    for own, low, high, bits, table in tables:
        met = bits @ ((codes[own] > low) & (codes[own] <= high))
        out[:, own] += table[met]
    return out, base


def attribute(rows: Rows, model: Model, key: str, given: DataFrame) -> DataFrame:
    """Key, base, prediction and shap_<feature> of every row of `given` under a model of `rows`.

    `given` has the key and the features; missing features take the replicate's mean. The leaf tables
    are a broadcast of the size of the model, of 2^k rows for a leaf whose path has k features.
    """
    features, layout = rows.features, rows.layout()
    tables, base = _tables(model)
    shared = given.sparkSession.sparkContext.broadcast((tables, base, model, layout))
    codes = F.array(*[bin_code(F.col(f).cast("double"), c) for f, c in zip(features, rows.cuts, strict=True)]).cast("array<int>")
    source = given.select(F.col(key).alias("key"), codes.alias("codes"))
    kind = source.schema["key"].dataType.simpleString()
    names = ["base", "prediction", *[f"shap_{f}" for f in features]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, base, model, layout = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            placed = layout.placed(model.rep, list_matrix(batch.column(1)).T)
            out = np.zeros((batch.num_rows, len(layout.features)))
            for own, low, high, bits, table in tables:
                met = bits @ ((placed[own] > low) & (placed[own] <= high))
                out[:, own] += table[met]
            columns = [np.full(batch.num_rows, base), model.predict(placed), *out.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in columns]], ["key", *names])

    made = source.mapInArrow(run, f"key {kind}, " + ", ".join(f"`{n}` double" for n in names))
    return made.withColumnRenamed("key", key)


def leaf_table(spark: SparkSession, models: Sequence[Model], rows: Rows) -> DataFrame:
    """The leaf paths as rows: one a leaf and feature, with the interval (low, high] that the leaf takes and the share that passes."""
    out = []
    for m in models:
        for k, tree in enumerate(m.trees):
            for leaf in leaves(tree, m.depth):
                whole = float(np.prod(leaf.share))
                bounds = [
                    (rows.features[f], rows.threshold(m.rep, f, lo) if lo >= 0 else None, rows.threshold(m.rep, f, hi) if hi < 1 << 30 else None, s)
                    for f, lo, hi, s in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True)
                ]
                out += [(m.rep, m.held, m.cell, k, leaf.node, leaf.value, whole, *b) for b in bounds or [(None, None, None, None)]]
    return spark.createDataFrame(out, LEAVES)
