"""One-pass moment aggregation: the shared base of every linear operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import Drawn, unpacked_draws
from ..functions.linalg import Moments

# Smallest variance, as a share of the mean square, computed without centring.
CANCELLATION = 1e-4
# Rows at either end of a batch's order in which the range of every group is looked for first.
EXTREME_ROWS = 128


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Column means as plain numbers (one small row reaches the driver)."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


def moments(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    by: Sequence[str] = (),
    centres: dict[str, float] | None = None,
) -> DataFrame:
    """Per group: row count, sums and cross products, and feature ranges.

    A single grouped aggregate with map-side combine; what is shuffled is one row
    of a few hundred doubles per group and task, whatever the number of rows.
    Subtracting ``centres`` first keeps the cross products well conditioned. Rows
    without a label must already be gone.
    """
    centres = centres or {}

    def centred(c: str) -> Column:
        return F.col(c) - F.lit(float(centres.get(c, 0.0)))

    z = [centred(c) for c in features] + [centred(label)]
    p = len(features)
    gap = [F.col(c).isNull() for c in features]

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    sums = [total(c) for c in z]
    sums += [total(z[i] * z[j]) for i in range(p + 1) for j in range(i, p + 1)]
    sums += [total(F.when(gap[j], z[i])) for j in range(p) for i in range(p + 1) if i != j]
    sums += [F.count_if(gap[i] & gap[j]).cast("double") for i in range(p) for j in range(i, p)]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*sums).alias("sums"),
        F.array(*[F.min(c) for c in z[:p]]).alias("lows"),
        F.array(*[F.max(c) for c in z[:p]]).alias("highs"),
    )


def _extremes(x: np.ndarray, code: np.ndarray, groups: Sequence[int], sign: int) -> np.ndarray:
    """(group, replicate): the least of x (the greatest for sign -1) among a group's rows, NaN without any.

    `code` has the group of a row in each replicate (replicates x rows). The few rows at the end of the
    order of x nearly always hold a row of every group; only groups they miss are looked up in all rows.
    """
    key = np.where(np.isnan(x), np.inf, sign * x)
    few = min(EXTREME_ROWS, len(x))
    near = np.argpartition(key, few - 1)[:few]
    near = near[np.argsort(key[near])]
    held, out = code[:, near], np.full((len(groups), len(code)), np.nan)
    for i, g in enumerate(groups):
        hit = held == g
        first = hit.argmax(axis=1)
        found = hit[np.arange(len(code)), first]
        out[i] = np.where(found, x[near[first]], np.nan)
        for rep in np.flatnonzero(~found):
            own = x[code[rep] == g]
            own = own[~np.isnan(own)]
            if len(own):
                out[i, rep] = sign * (sign * own).min()
    return out


def replicated_moments(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    draws: Drawn,
    groups: Sequence[int],
    code: Callable[[np.ndarray], np.ndarray],
    extra: Callable[[np.ndarray], np.ndarray] | None = None,
    centres: dict[str, float] | None = None,
) -> DataFrame:
    """(rep, code, n, sums, lows, highs): the moments of every replicate and group from one scan.

    ``code`` turns a matrix of draws (rows x replicates) into groups, all of them named in ``groups``; a row
    without draws is in none. A task builds the products of a batch of rows once and multiplies them with the
    group indicators of all replicates as a matrix, so rows are not copied per replicate; the last group is
    what the others leave of all rows. ``extra`` may give the value of one more, always present, feature for
    each draw; it comes after the others. A task sends one row per replicate and group.
    """
    centres = centres or {}
    has_extra = extra is not None
    groups, p, n_features, count = list(groups), len(features) + has_extra, len(features), draws.count
    shift = np.array([centres.get(c, 0.0) for c in [*features, *(["__extra"] if has_extra else []), label]])
    # Columns of the products: 0 is one, then the features and the label, then their gaps.
    z = [1 + i for i in range(p + 1)]
    gap = [2 + p + i for i in range(p)]
    pairs = [(0, 0)] + [(0, i) for i in z]
    pairs += [(z[i], z[j]) for i in range(p + 1) for j in range(i, p + 1)]
    pairs += [(gap[j], z[i]) for j in range(p) for i in range(p + 1) if i != j]
    pairs += [(gap[i], gap[j]) for i in range(p) for j in range(i, p)]
    rows = df.select(draws.text.alias("__draws"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate([*features, label])])

    # The extra feature is the last one; it has no gaps, and only its own products differ by replicate.
    extra_at, no_gap = (p, gap[-1]) if has_extra else (-1, -1)
    kept = [c for c in range(2 + 2 * p) if c not in (extra_at, no_gap)]
    place = {c: i for i, c in enumerate(kept)}
    plain = [k for k, pair in enumerate(pairs) if not {extra_at, no_gap} & set(pair)]
    mixed = [(k, place[x if y == extra_at else y]) for k, (x, y) in enumerate(pairs) if (x == extra_at) != (y == extra_at) and no_gap not in (x, y)]
    square = [k for k, pair in enumerate(pairs) if pair == (extra_at, extra_at)]
    left, right = (np.array([place[pairs[k][side]] for k in plain]) for side in (0, 1))
    at_mixed, of_mixed = (np.array(x, dtype=int) for x in (zip(*mixed, strict=True) if mixed else ([], [])))
    shifts = np.append(shift[:n_features], shift[-1])
    extra_shift = shift[n_features] if has_extra else 0.0
    n_pairs = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(groups), count, n_pairs))
        lows, highs = np.full((len(groups), count, p), np.nan), np.full((len(groups), count, p), np.nan)
        for batch in batches:
            drawn, known = unpacked_draws(batch.column(0), count)
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            if not known.all():
                drawn, values = drawn[known], values[known]
            if not len(values):
                continue
            values = values - shifts
            own = np.ascontiguousarray(code(drawn).T)
            added = np.ascontiguousarray(extra(drawn).T) - extra_shift if has_extra else None
            missing = np.isnan(values)
            base = np.hstack([np.ones((len(values), 1)), np.where(missing, 0.0, values), missing[:, :n_features].astype(float)])
            whole = base[:, left] * base[:, right]
            rest = np.zeros((count, n_pairs))
            rest[:, plain] = whole.sum(axis=0)
            if has_extra:
                rest[:, at_mixed] = (added @ base)[:, of_mixed]
                rest[:, square] = np.einsum("ij,ij->i", added, added)[:, None]
            for i, g in enumerate(groups):
                inside = own == g
                part = rest
                if i < len(groups) - 1:
                    weight = inside.astype(float)
                    part = np.zeros((count, n_pairs))
                    part[:, plain] = weight @ whole
                    if has_extra:
                        weight *= added
                        part[:, at_mixed] = (weight @ base)[:, of_mixed]
                        part[:, square] = np.einsum("ij,ij->i", weight, added)[:, None]
                    rest = rest - part
                # Counts are whole numbers; a group without rows has no sums but rounding.
                some = part[:, 0] > 0
                sums[i, some] += part[some]
                if has_extra:
                    low, high = (f.reduce(added, axis=1, where=inside, initial=v) for f, v in ((np.minimum, np.inf), (np.maximum, -np.inf)))
                    lows[i, some, -1], highs[i, some, -1] = np.fmin(lows[i, some, -1], low[some]), np.fmax(highs[i, some, -1], high[some])
            for f in range(n_features):
                lows[:, :, f] = np.fmin(lows[:, :, f], _extremes(values[:, f], own, groups, 1))
                highs[:, :, f] = np.fmax(highs[:, :, f], _extremes(values[:, f], own, groups, -1))
        none = lambda x: [None if np.isnan(v) else float(v) for v in x]
        at = [(rep, i) for i in range(len(groups)) for rep in range(count) if sums[i, rep, 0] > 0]
        columns = [
            pa.array([rep for rep, _ in at], pa.int32()), pa.array([groups[i] for _, i in at], pa.int32()), pa.array([int(sums[i, rep, 0]) for rep, i in at], pa.int64()),
            pa.array([sums[i, rep, 1:] for rep, i in at], pa.list_(pa.float64())), *[pa.array([none(x[i, rep]) for rep, i in at], pa.list_(pa.float64())) for x in (lows, highs)],
        ]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "code", "n", "sums", "lows", "highs"])

    parts = rows.mapInArrow(run, "rep int, code int, n bigint, sums array<double>, lows array<double>, highs array<double>")
    each = lambda fn, c, k: F.array(*[fn(F.col(c)[i]) for i in range(k)]).alias(c)
    return parts.groupBy("rep", "code").agg(
        F.sum("n").alias("n"), each(F.sum, "sums", len(pairs) - 1), each(F.min, "lows", p), each(F.max, "highs", p)
    )


def collect_conditioned(
    df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()
) -> tuple[dict[tuple, Moments], dict[str, float]]:
    """Moments per group on the driver, and the centres they are relative to."""
    return conditioned(lambda centres: collect_moments(moments(df, features, label, by, centres), by), [*features, label])


def conditioned(
    collect: Callable[[dict[str, float]], dict[tuple, Moments]], columns: Sequence[str]
) -> tuple[dict[tuple, Moments], dict[str, float]]:
    """What ``collect`` gives relative to centres, and the centres.

    One pass over the rows is enough unless a column's spread is tiny beside its
    mean, where subtracting squares would lose digits; only then a second pass is
    made around the means the first one found.
    """
    groups = collect({})
    if not groups:
        raise ValueError("no rows to fit on")
    n = sum(m.n for m in groups.values())
    gaps = sum(np.append(np.diag(m.N), 0.0) for m in groups.values())
    present = np.maximum(n - gaps, 1.0)
    mean = sum(m.s for m in groups.values()) / present
    square = sum(np.diag(m.S) for m in groups.values()) / present
    spread = square - mean**2
    if np.all((spread > CANCELLATION * square) | (square == 0)):
        return groups, {}
    centres = dict(zip(columns, (float(v) for v in mean), strict=True))
    return collect(centres), centres


def collect_moments(df: DataFrame, by: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Moment rows as matrices on the driver; for a bounded number of groups."""
    return {tuple(r[c] for c in by): Moments.unpack(r["n"], r["sums"], r["lows"], r["highs"]) for r in df.collect()}
