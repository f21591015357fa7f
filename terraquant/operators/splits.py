"""How a tree chooses its splits from the sums of its frontier.

The sums of a node are counts and label totals by feature and slot. All rules maximise the fall of the
squared error with an `l2` penalty on leaf values; ties go to the first feature, then the first slot.
Every random choice is a function of the tree's name, the node's path and the feature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Growth:
    """How trees grow; `drawn` takes one drawn threshold a feature, `symmetric` one split for a whole level."""

    max_depth: int = 5
    min_leaf: float = 1
    max_leaves: int | None = None
    l2: float = 0.0
    symmetric: bool = False
    drawn: bool = False
    bootstrap: bool = False
    subsample: float = 1.0
    features_per_node: int | None = None
    features_per_tree: int | None = None


def unit(*name) -> float:
    """A draw from [0, 1): the first 32 bits of the md5 of the name's parts, joined by colons."""
    return int(hashlib.md5(":".join(map(str, name)).encode()).hexdigest()[:8], 16) / 2.0**32


def drawn_features(name: tuple, count: int | None, features: Sequence[int]) -> list[int]:
    """`count` features with the smallest draws of (name, feature); all without a count."""
    if count is None or count >= len(features):
        return list(features)
    return sorted(sorted(features, key=lambda f: (unit(*name, f), f))[:count])


def allowed(growth: Growth, tree: tuple, features: Sequence[int] | None, n_features: int, path: int) -> list[int]:
    own = list(range(n_features)) if features is None else list(features)
    own = drawn_features(("tree", *tree), growth.features_per_tree, own)
    return drawn_features(("node", *tree, path), growth.features_per_node, own)


def gains(sums: np.ndarray, l2: float, min_leaf: float) -> np.ndarray:
    """Fall of the squared error for a cut after every slot, of every (node, feature); -inf where a side is too small."""
    left = np.cumsum(sums, axis=-1)
    whole = left[..., -1:]
    right = whole - left
    least = max(min_leaf, 1e-9)
    fine = (left[:, 0] >= least) & (right[:, 0] >= least)
    score = lambda x: x[:, 1] ** 2 / np.where(x[:, 0] + l2 > 0, x[:, 0] + l2, 1)
    return np.where(fine, score(left) + score(right) - score(whole), -np.inf)


def _drawn_slots(tree: tuple, path: int, count: np.ndarray, values: Sequence[np.ndarray]) -> list[tuple[int, float] | None]:
    """Per feature the last slot at or below a threshold drawn between the node's least and greatest value."""
    out = []
    for f, own in enumerate(values):
        held = np.flatnonzero(count[f, : len(own)] > 0)
        if not len(held) or own[held[0]] == own[held[-1]]:
            out.append(None)
            continue
        low, high = float(own[held[0]]), float(own[held[-1]])
        cut = low + unit("cut", *tree, path, f) * (high - low)
        out.append((int(np.searchsorted(own, cut, side="right")) - 1, cut))
    return out


def choose(
    growth: Growth, tree: tuple, features: Sequence[int] | None, nodes: Sequence[tuple[int, int]], sums: np.ndarray, values: Sequence[np.ndarray]
) -> list[tuple]:
    """Per node (n, total, split or None); a split is (feature, slot, threshold or None, gain, ((n, total) left, right)).

    `nodes` are (path, depth), `sums` has (node, count or total, feature, slot), `values` the slots' values.
    """
    gain = gains(sums, growth.l2, growth.min_leaf)
    n_features = sums.shape[2]
    cuts: list = [None] * len(nodes)
    for k, (path, _) in enumerate(nodes):
        closed = np.ones(n_features, bool)
        closed[allowed(growth, tree, features, n_features, 1 if growth.symmetric else path)] = False
        gain[k, closed] = -np.inf
        if growth.drawn:
            cuts[k] = _drawn_slots(tree, path, sums[k, 0], values)
            for f, cut in enumerate(cuts[k]):
                kept = gain[k, f, cut[0]] if cut else -np.inf
                gain[k, f] = -np.inf
                if cut:
                    gain[k, f, cut[0]] = kept
    if growth.symmetric and len(nodes):
        # One cut for the level: the sum of its gains; a node that it leaves whole gains nothing by it.
        level = np.where(np.isfinite(gain), gain, 0.0).sum(axis=0)
        level[~np.isfinite(gain).any(axis=0)] = -np.inf
        common = int(np.argmax(level))
        useful = bool(np.isfinite(level.flat[common]) and level.flat[common] > 0)
    out = []
    for k in range(len(nodes)):
        whole = sums[k, :, 0].sum(axis=-1)
        at = common if growth.symmetric else int(np.argmax(gain[k]))
        fine = useful if growth.symmetric else np.isfinite(gain[k].flat[at]) and (gain[k].flat[at] > 0 or growth.drawn)
        split = None
        if fine:
            f, slot = divmod(at, sums.shape[3])
            left = sums[k, :, f, : slot + 1].sum(axis=-1)
            sides = tuple((float(n), float(t)) for n, t in (left, whole - left))
            drawn = cuts[k][f][1] if growth.drawn else None
            split = (f, slot, drawn, float(gain[k].flat[at]) if np.isfinite(gain[k].flat[at]) else 0.0, sides)
        out.append((float(whole[0]), float(whole[1]), split))
    return out
