"""Regression trees, many at a time: levels of all seeds, folds, cells and trees from shared scans.

A scan of the binned rows adds up, for every tree and every node of its frontier, the counts and label
sums of all bins, as numpy arrays in Arrow batches; rows find their node by walking the trees grown so
far, a broadcast of the size of the models. The sums of a tree meet in one task, which chooses its
splits. Plain trees, forests with bootstrap, trees with drawn thresholds, leaf-wise and symmetric
boosting differ only in how splits are chosen from the sums (`operators.splits`).

A tree with a smaller depth limit is the upper part of a deeper one, so a grid over depths grows one
tree and reads every node's value. Missing features take the mean of the replicate's training rows,
as a value of its own between the bins beside it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import Drawn, unpacked_draws
from ..session import materialise
from .splits import Growth, choose, drawn_features

# Bytes of sums that a task may hold for the trees of one scan.
SCAN_BYTES = 96 << 20
# Bytes of sums of all tasks together below which they are added up on the driver.
DIRECT_BYTES = 8 << 20
# Rounds of boosting after which the margins so far are written beside the rows.
REFRESH = 10
# Rows of a block of the written table; each of its columns is one array.
BLOCK_ROWS = 1 << 16
# Rows that a task brings together by their codes, and the most combinations of codes for which it does so.
JOINED_ROWS = 1 << 20
JOINED_CELLS = 1 << 17
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])


@dataclass(frozen=True)
class Spec:
    """One tree to grow: its replicate, the fold left out (-1: none), its number, and how it grows."""

    rep: int
    held: int = -1
    number: int = 0
    growth: Growth = field(default_factory=Growth)
    features: tuple[int, ...] | None = None
    target: int = 0


@dataclass
class Tree:
    """Nodes as arrays, the root first; feature -1 marks a leaf. Rows with code <= slot go left."""

    spec: Spec
    feature: list[int] = field(default_factory=lambda: [-1])
    slot: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [float("nan")])
    left: list[int] = field(default_factory=lambda: [-1])
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [1])
    n: list[float] = field(default_factory=lambda: [0.0])
    total: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    # Splits found for leaves that are not taken yet.
    pending: dict[int, tuple] = field(default_factory=dict)

    def split(self, node: int, feature: int, slot: int, threshold: float, gain: float, sides: Sequence[tuple[float, float]]) -> list[int]:
        """Give a node two children, each with its (n, total); returns their numbers."""
        self.feature[node], self.slot[node], self.threshold[node], self.gain[node] = feature, slot, threshold, gain
        self.left[node] = len(self.feature)
        for side, (n, total) in enumerate(sides):
            self.feature.append(-1)
            self.slot.append(0)
            self.threshold.append(float("nan"))
            self.left.append(-1)
            self.parent.append(node)
            self.path.append(2 * self.path[node] + side)
            self.n.append(n)
            self.total.append(total)
            self.gain.append(0.0)
        return [self.left[node], self.left[node] + 1]

    def depth(self, node: int) -> int:
        return self.path[node].bit_length() - 1

    def value(self) -> np.ndarray:
        n = np.array(self.n) + self.spec.growth.l2
        return np.array(self.total) / np.where(n > 0, n, 1)

    def arrays(self) -> tuple:
        return np.array(self.feature), np.array(self.slot), np.array(self.left)


def walk(arrays: tuple, codes: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The node that every row of codes (features x rows) ends in, at most `depth` splits down."""
    feature, slot, left = arrays
    at = np.zeros(codes.shape[1], np.int64)
    rows = np.arange(codes.shape[1])
    step = 0
    while len(rows) and (depth is None or step < depth):
        own = at[rows]
        inner = feature[own] >= 0
        rows, own = rows[inner], own[inner]
        at[rows] = left[own] + (codes[feature[own], rows] > slot[own])
        step += 1
    return at


@dataclass
class Rows:
    """Binned training data: a written table of blocks of rows and what reads it.

    `table` shows the rows as (parts, codes, y, draws): `parts` has the part of a row in each replicate, -1 for its test
    rows; a code is the number of cuts below the value, -1 for a missing one. A block holds the same as arrays.
    """

    table: DataFrame
    blocks: DataFrame
    features: tuple[str, ...]
    cuts: list[np.ndarray]
    values: list[np.ndarray | None]
    means: np.ndarray
    folds: int
    sums: np.ndarray
    splits: int = 1

    @property
    def spark(self) -> SparkSession:
        return self.blocks.sparkSession

    @property
    def slots(self) -> int:
        return max(len(c) for c in self.cuts) + 2

    def missing_slot(self, rep: int, f: int) -> tuple[int, bool]:
        """Where the replicate's mean stands among the bins of a feature, and whether it is a slot of its own."""
        mean, cuts, values = self.means[rep, f], self.cuts[f], self.values[f]
        code = int(np.searchsorted(cuts, mean, side="left"))
        if values is None or mean == values[code]:
            return code, False
        return code + int(mean > values[code]), True

    @property
    def code_type(self) -> type:
        return np.uint8 if self.slots < 255 else np.uint16

    @property
    def few_cells(self) -> bool:
        """Whether the bins allow so few combinations of codes that rows may be brought together by them."""
        return float(np.prod([len(c) + 2.0 for c in self.cuts])) <= JOINED_CELLS

    def layout(self) -> Rows:
        """What workers need of the rows."""
        return replace(self, table=None, blocks=None)

    def sums_in_place(self, rep: int, sums: np.ndarray) -> np.ndarray:
        """Sums by (.., feature, node, written code), the missing one first, as sums by slot of a replicate."""
        out = np.zeros_like(sums)
        for f in range(sums.shape[1]):
            at, own = self.missing_slot(rep, f)
            missing, known = sums[:, f, :, 0], sums[:, f, :, 1:]
            out[:, f, :, :at] = known[..., :at]
            if own:
                out[:, f, :, at + 1 :] = known[..., at:]
            else:
                out[:, f, :, at:-1] = known[..., at:]
            out[:, f, :, at] += missing
        return out

    def placed(self, rep: int, codes: np.ndarray) -> np.ndarray:
        """Codes of a replicate (features x rows): the missing value in its place, the bins above it one slot on."""
        out = np.empty_like(codes)
        for f in range(len(codes)):
            at, own = self.missing_slot(rep, f)
            out[f] = np.where(codes[f] < 0, at, codes[f] + (codes[f] >= at) if own else codes[f])
        return out

    def slot_values(self, rep: int, f: int) -> np.ndarray:
        """A value for each slot, in order; bins of many values are represented by their upper cut."""
        values = self.values[f]
        if values is None:
            cuts = self.cuts[f]
            return np.append(cuts, cuts[-1] if len(cuts) else 0.0)
        at, own = self.missing_slot(rep, f)
        return np.insert(values, at, self.means[rep, f]) if own else values

    def threshold(self, rep: int, f: int, slot: int) -> float:
        """Between a slot and the next; a cut where bins hold many values."""
        if self.values[f] is None:
            return float(self.cuts[f][slot])
        values = self.slot_values(rep, f)
        return float((values[slot] + values[min(slot + 1, len(values) - 1)]) / 2)

    def train_sums(self, rep: int, held: int, target: int = 0) -> tuple[float, float]:
        """Rows and total of a label over a replicate's training rows without the fold left out."""
        parts = [p for p in range(self.folds) if p != held]
        return float(self.sums[rep, parts, 0].sum()), float(self.sums[rep, parts, 1 + target].sum())


def feature_bins(df: DataFrame, features: Sequence[str], bins: int) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Cuts of each feature, and its values where no more than `bins` differ: then every value has a bin."""
    shares = [i / bins for i in range(1, bins)]
    x = [F.col(f).cast("double") for f in features]
    told = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(x)], *[F.percentile_approx(c, shares, 100 * bins).alias(f"q{i}") for i, c in enumerate(x)]).first()
    cuts, values = [], []
    for i, c in enumerate(x):
        seen = None
        if told[f"n{i}"] <= 1.2 * bins:
            seen = [r[0] for r in df.where(c.isNotNull()).select(c.alias("x")).distinct().limit(bins + 1).collect()]
        if seen is not None and len(seen) <= bins:
            own = np.sort(np.array(seen or [0.0]))
            values.append(own)
            cuts.append((own[:-1] + own[1:]) / 2)
        else:
            values.append(None)
            cuts.append(np.unique(told[f"q{i}"]))
    return cuts, values


def bin_code(value: Column, cuts: np.ndarray) -> Column:
    """The number of cuts below a value, -1 for a missing one."""
    below = F.lit(0)
    if len(cuts):
        below = F.aggregate(F.array(*map(F.lit, cuts.tolist())), F.lit(0), lambda acc, cut: acc + (value > cut).cast("int"))
    return F.when(value.isNull(), F.lit(-1)).otherwise(below)


def _packed(matrix: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    raw = np.ascontiguousarray(matrix).view(np.uint8).reshape(len(matrix), -1)
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _unpacked(column: pa.Array, dtype) -> np.ndarray:
    """Rows x values of a binary column of rows of equal length."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.reshape(len(column), -1).view(dtype) if len(raw) else np.zeros((len(column), 0), dtype)


def _given_rows(df: DataFrame, x: Sequence[Column], labels: Sequence[Column], parts: Column | Drawn, folds: int, draws: Column | Drawn | None) -> DataFrame:
    """(parts, draws, y0.., x0..): a byte a replicate (0 test, 255 none, else one more than the fold), four bytes a draw."""
    # What workers need of draws: how many, and the limit of test rows.
    split, chance = ((d.count, d.limit) if isinstance(d, Drawn) else None for d in (parts, draws))
    names = [*[f"y{i}" for i in range(len(labels))], *[f"x{i}" for i in range(len(x))]]
    source = df.select(
        parts.text.alias("parts") if split else parts.cast("array<int>").alias("parts"),
        draws.text.alias("draws") if chance else (F.array() if draws is None else draws).cast("array<long>").alias("draws"),
        *[c.cast("double").alias(n) for c, n in zip([*labels, *x], names, strict=True)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if split:
                drawn, known = unpacked_draws(batch.column(0), split[0])
                part = np.where(drawn < split[1], 0, drawn % np.uint32(folds) + 1)
                part[~known] = 255
            else:
                part = list_matrix(batch.column(0)) + 1
                part = np.where(np.isnan(part), 255, part) if part.dtype.kind == "f" else part
            own = unpacked_draws(batch.column(1), chance[0])[0] if chance else list_matrix(batch.column(1))
            columns = [_packed(part.astype(np.uint8)), _packed(own.astype(">u4")), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["parts", "draws", *names])

    return source.mapInArrow(run, "parts binary, draws binary, " + ", ".join(f"{n} double" for n in names))


def _blocks(given: DataFrame, cuts: Sequence[np.ndarray], n_labels: int, code_type: type) -> DataFrame:
    """(n, parts, codes, y, draws): blocks of rows, replicate, feature, label or draw first; a code is one more than the cuts below, 0 if missing."""

    def made(parts, draws, y, codes) -> pa.RecordBatch:
        arrays = [np.concatenate(c, axis=1) for c in (parts, codes, y, draws)]
        return pa.RecordBatch.from_arrays(
            [pa.array([arrays[0].shape[1]], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], ["n", "parts", "codes", "y", "draws"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2 : 2 + n_labels]])
            x = [np.where(c.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(own, c.to_numpy(zero_copy_only=False)) + 1) for c, own in zip(batch.columns[2 + n_labels :], cuts, strict=True)]
            held.append((_unpacked(batch.column(0), np.uint8).T, _unpacked(batch.column(1), ">u4").T.astype(np.uint32), y, np.stack(x).astype(code_type)))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield made(*zip(*held, strict=True))
                held, size = [], 0
        if held:
            yield made(*zip(*held, strict=True))

    return given.mapInArrow(run, "n int, parts binary, codes binary, y binary, draws binary")


def prepare(
    df: DataFrame, features: Sequence[str], label: str | Sequence[str], parts: Column | Drawn, folds: int, bins: int = 128, draws: Column | Drawn | None = None
) -> Rows:
    """Bin the rows once and write them; one scan then gives every replicate's means and label sums.

    Trees name the label they are grown on by its place in `label`. `parts` is an array with the part of the row in each replicate (-1 test, else its fold),
    or the draws that decide it; `draws` has a 32-bit draw for each tree number, for growth with bootstrap. Rows without a label
    must be gone; an empty table is an error.
    """
    features, labels = tuple(features), [label] if isinstance(label, str) else list(label)
    x, n_labels, n_features = [f"x{i}" for i in range(len(features))], len(labels), len(features)
    given = materialise(_given_rows(df, [F.col(f) for f in features], [F.col(c) for c in labels], parts, folds, draws), "growth-input")
    cuts, values = feature_bins(given, x, bins)
    width = folds + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = _unpacked(batch.column(0), np.uint8)
            both = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            y, x = both[:, :n_labels], both[:, n_labels:]
            known = ~np.isnan(x)
            base = np.hstack([np.ones((len(y), 1)), y, np.where(known, x, 0.0), known])
            if total is None:
                total = np.zeros((part.shape[1], width, base.shape[1]))
            for p in range(-1, folds):
                total[:, p] += (part == p + 1).astype(float).T @ base
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.shape[0]]), pa.array([total.tobytes()], pa.binary())], ["reps", "sums"])

    found = given.select("parts", *[f"y{i}" for i in range(n_labels)], *x).mapInArrow(run, "reps long, sums binary").collect()
    if not found:
        raise ValueError("no rows to grow trees on")
    first = 1 + n_labels
    shape = (found[0]["reps"], width, first + 2 * n_features)
    sums = sum(np.frombuffer(r["sums"]).reshape(shape) for r in found)
    train = sums[:, :folds].sum(axis=1)
    counts = train[:, first + n_features :]
    means = train[:, first : first + n_features] / np.where(counts > 0, counts, 1)
    out = Rows(_row_view(given, cuts, n_labels, shape[0]), None, features, cuts, values, means, folds, sums)
    blocks = materialise(_blocks(given, cuts, n_labels, out.code_type), "growth-blocks")
    return replace(out, blocks=blocks, splits=blocks.rdd.getNumPartitions())


def _row_view(given: DataFrame, cuts: Sequence[np.ndarray], n_labels: int, reps: int) -> DataFrame:
    number = lambda column, at, size: F.conv(F.hex(F.substr(F.col(column), at, F.lit(size))), 16, 10).cast("long")
    part = F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda i: number("parts", i, 1))
    draws = F.transform(F.sequence(F.lit(0), F.expr("cast(length(draws) div 4 as int) - 1")), lambda i: number("draws", 1 + 4 * i, 4))
    return given.select(
        F.transform(part, lambda p: F.when(p < 255, p - 1)).cast("array<int>").alias("parts"),
        F.array(*[bin_code(F.col(f"x{i}"), c) for i, c in enumerate(cuts)]).cast("array<int>").alias("codes"),
        F.array(*[F.col(f"y{i}") for i in range(n_labels)]).alias("y"),
        F.when(F.length("draws") > 0, draws).otherwise(F.array().cast("array<long>")).alias("draws"),
    )


def list_matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows x length."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass
class Path:
    """A tree as steps over written codes: (column, least code that goes right less one, node, distance to its left child)."""

    steps: list[tuple[int, int, int, int]]
    nodes: int

    @staticmethod
    def of(tree: Tree, layout: Rows, depth: int | None = None) -> Path:
        n_features, steps = len(layout.features), []
        for node, f in enumerate(tree.feature):
            if f < 0 or (depth is not None and tree.depth(node) >= depth):
                continue
            at, own = layout.missing_slot(tree.spec.rep, f)
            slot = tree.slot[node]
            right = at > slot
            # A missing value is below all codes in column f, and above all codes in column n_features + f.
            steps.append((f + n_features * right, slot + (0 if own and not right else 1), node, tree.left[node] - node))
        return Path(steps, len(tree.feature))

    @property
    def dtype(self) -> type:
        return np.uint8 if self.nodes < 255 else np.uint16 if self.nodes < 65535 else np.uint32

    @property
    def outside(self) -> int:
        """A number that no node has."""
        return self.nodes if self.dtype is np.uint32 else np.iinfo(self.dtype).max

    def ends(self, codes: np.ndarray) -> np.ndarray:
        """The node that every row ends in: a child has a larger number than its parent, so one sweep is enough."""
        at = np.zeros(codes.shape[1], self.dtype)
        for column, code, node, step in self.steps:
            move = (codes[column] > code).astype(self.dtype)
            move += self.dtype(step)
            move *= at == node
            at += move
        return at


@dataclass
class Chunk:
    """Rows of a task in memory. `codes` are those of single rows, or of cells, and `cell` then is the cell of each row."""

    parts: np.ndarray
    codes: np.ndarray
    y: np.ndarray
    draws: np.ndarray
    margins: np.ndarray | None = None
    cell: np.ndarray | None = None
    folds: int = 0
    known: dict = field(default_factory=dict)

    def remembered(self, name: tuple, make) -> np.ndarray:
        if name not in self.known:
            self.known[name] = make()
        return self.known[name]

    def drawn_weight(self, spec: Spec) -> np.ndarray | None:
        """How often each row counts in a tree by its draw, or none where every row counts once."""
        if not spec.growth.bootstrap and spec.growth.subsample >= 1:
            return None
        own = self.draws[spec.number]

        def make() -> np.ndarray:
            weight = np.ones(len(own))
            if spec.growth.bootstrap:
                weight = sum((own >= c).astype(np.uint8) for c in np.ceil(POISSON * 2.0**32)).astype(float)
            return weight * (own < spec.growth.subsample * 2.0**32) if spec.growth.subsample < 1 else weight

        return self.remembered(("draw", spec.number, spec.growth.bootstrap, spec.growth.subsample), make)

    def cell_sums(self, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
        """(part + 1, cell): weight and weighted label of a replicate's rows, before any fold is left out."""
        n_cells = self.codes.shape[1]
        weight = self.drawn_weight(spec)
        at = self.remembered(("at", spec.rep), lambda: np.minimum(self.parts[spec.rep], self.folds + 1).astype(np.int64) * n_cells + self.cell)
        shape, name = (self.folds + 2, n_cells), (spec.rep, spec.number if weight is not None else -1, spec.growth.bootstrap, spec.growth.subsample)
        label = self.y[spec.target]
        count = self.remembered(("n", *name), lambda: np.bincount(at, weight, shape[0] * n_cells).reshape(shape).astype(float))
        total = self.remembered(("s", *name, spec.target), lambda: np.bincount(at, label if weight is None else label * weight, shape[0] * n_cells).reshape(shape))
        return count, total

    def forget(self, rep: int) -> None:
        """Drop what was kept for a replicate."""
        for name in [n for n in self.known if n[0] in ("at", "n", "s", "own", "outside") and n[1] == rep]:
            del self.known[name]


def _matrix(array: pa.Scalar, dtype, n: int) -> np.ndarray:
    """An array of a block, with n columns."""
    raw = array.as_buffer()
    return np.frombuffer(raw, dtype).reshape(-1, n) if raw.size else np.zeros((0, n), dtype)


def both_ends(codes: np.ndarray) -> np.ndarray:
    """Written codes, then the same with the missing value above all others."""
    return np.concatenate([codes, np.where(codes == 0, np.iinfo(codes.dtype).max, codes)])


def _chunks(batches: Iterator[pa.RecordBatch], layout: Rows) -> Iterator[Chunk]:
    """The blocks of a task; where the bins allow few combinations of codes, many blocks together with their rows' cells."""
    sizes = [len(c) + 2 for c in layout.cuts]
    cells, few = int(np.prod([float(s) for s in sizes])), layout.few_cells
    held: list[Chunk] = []
    rows = 0

    def joined() -> Chunk:
        parts, codes, y, draws = (np.concatenate([getattr(c, k) for c in held], axis=1) for k in ("parts", "codes", "y", "draws"))
        margins = np.concatenate([c.margins for c in held], axis=1) if held[0].margins is not None else None
        chunk = Chunk(parts, both_ends(codes), y, draws, margins, folds=layout.folds)
        # Margins are functions of the codes, but are written by row; such rows stay single.
        if few and margins is None:
            cell = np.ravel_multi_index(tuple(c.astype(np.int64) for c in codes), sizes)
            used = np.flatnonzero(np.bincount(cell, minlength=cells))
            if 2 * len(used) <= codes.shape[1]:
                place = np.zeros(cells, np.int64)
                place[used] = np.arange(len(used))
                own = np.stack(np.unravel_index(used, sizes)).astype(codes.dtype)
                chunk = replace(chunk, codes=both_ends(own), cell=place[cell])
        return chunk

    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column(0)[i].as_py()
            if not n:
                continue
            held.append(Chunk(*(_matrix(c[i], t, n) for c, t in zip(batch.columns[1:], (np.uint8, layout.code_type, float, np.uint32, float), strict=False))))
            rows += n
            if rows >= (JOINED_ROWS if few and held[0].margins is None else BLOCK_ROWS):
                yield joined()
                held, rows = [], 0
    if held:
        yield joined()


@dataclass
class Margins:
    """What boosted models predict so far: a start per model, and the trees since the margins were last written."""

    start: np.ndarray
    rate: float
    trees: list[list[Tree]] = field(default_factory=list)
    written: bool = False

    def paths(self, layout: Rows) -> list[list[tuple[Path, np.ndarray]]]:
        return [[(Path.of(t, layout), self.rate * t.value()) for t in round_] for round_ in self.trees]

    def of(self, model: int, chunk: Chunk, paths: list[list[tuple[Path, np.ndarray]]]) -> np.ndarray:
        """Per row, or per cell of the chunk."""
        out = np.full(chunk.codes.shape[1], self.start[model]) if chunk.margins is None else chunk.margins[model].copy()
        for round_ in paths:
            path, values = round_[model]
            out += values.take(path.ends(chunk.codes))
        return out


def _tree_features(spec: Spec, n_features: int) -> list[int]:
    """The features that a tree may split on at all."""
    own = list(range(n_features)) if spec.features is None else list(spec.features)
    return drawn_features(("tree", spec.rep, spec.held, spec.number), spec.growth.features_per_tree, own)


def _add_sums(total: np.ndarray, chunk: Chunk, spec: Spec, path: Path, place: np.ndarray, features: Sequence[int], slots: int, margin: np.ndarray | None) -> None:
    """Add a chunk's rows to the sums of a tree's frontier: (count or total, feature, (node, written code)), the last node for other rows."""
    at = path.ends(chunk.codes)
    length = total.shape[2]
    if chunk.cell is None:
        weight, part = chunk.drawn_weight(spec), chunk.parts[spec.rep]
        # Test rows have part 0, rows of none 255.
        outside = chunk.remembered(("outside", spec.rep, spec.held), lambda: (part == 0) | (part == spec.held + 1) | (part == 255))
        np.copyto(at, path.dtype(path.outside), where=outside)
        label = chunk.y[spec.target] if margin is None else chunk.y[spec.target] - margin
        label = label if weight is None else label * weight
    else:
        count, sums = chunk.cell_sums(spec)
        inside = [p for p in range(1, chunk.folds + 1) if p != spec.held + 1]
        weight, label = count[inside].sum(axis=0), sums[inside].sum(axis=0)
        label = label if margin is None else label - margin * weight
    base = place.take(at)
    for f in features:
        index = base + chunk.remembered(("code", f), lambda f=f: chunk.codes[f].astype(np.int64))
        total[0, f] += np.bincount(index, weight, length)
        total[1, f] += np.bincount(index, label, length)


def _scan(rows: Rows, trees: list[Tree], frontier: list[list[int]], margins: Margins | None) -> DataFrame:
    """(tree, sums): counts and label totals of (frontier node, feature, slot), one row a tree and task."""
    slots, n_features = rows.slots, len(rows.features)
    layout = rows.layout()
    # Replicate by replicate, so that what is kept for one can be dropped.
    work = sorted(((i, tree, nodes) for i, (tree, nodes) in enumerate(zip(trees, frontier, strict=True)) if nodes), key=lambda w: w[1].spec.rep)
    shared = rows.spark.sparkContext.broadcast((work, margins))
    columns = ["n", "parts", "codes", "y", "draws", *(["margins"] if margins and margins.written else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, margins = shared.value
        paths = margins.paths(layout) if margins else None
        plans = []
        for i, tree, nodes in work:
            path = Path.of(tree, layout)
            # Rows outside the frontier and outside the training rows go to one more node.
            place = np.full(path.outside + 1, len(nodes) * slots)
            place[nodes] = np.arange(len(nodes)) * slots
            plans.append((i, tree.spec, path, place, _tree_features(tree.spec, n_features), np.zeros((2, n_features, (len(nodes) + 1) * slots))))
        for chunk in _chunks(batches, layout):
            before = None
            for i, spec, path, place, features, total in plans:
                if before not in (None, spec.rep):
                    chunk.forget(before)
                before = spec.rep
                _add_sums(total, chunk, spec, path, place, features, slots, margins.of(i, chunk, paths) if margins else None)
        for i, spec, _, _, features, total in plans:
            if 0 not in features:
                # The first feature stands for the whole node.
                whole = total[:, features[0]].reshape(2, -1, slots)
                total[:, 0].reshape(2, -1, slots)[..., 0] = whole.sum(axis=2)
            sums = layout.sums_in_place(spec.rep, total.reshape(2, n_features, -1, slots)[:, :, :-1])
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([sums.tobytes()], pa.binary())], ["tree", "sums"])

    return rows.blocks.select(*columns).mapInArrow(run, "tree long, sums binary")


def _chosen(rows: Rows, trees: list[Tree], frontier: list[list[int]], margins: Margins | None) -> dict[int, list]:
    """Per tree, what `choose` takes from the sums of its frontier.

    A tree's sums meet in one task, which sends its splits. Where the sums of all tasks together are
    small, they are added up without that second stage.
    """
    slots, n_features = rows.slots, len(rows.features)
    told = {
        i: (t.spec, [(t.path[n], t.depth(n)) for n in nodes], [rows.slot_values(t.spec.rep, f) for f in range(n_features)])
        for i, (t, nodes) in enumerate(zip(trees, frontier, strict=True))
        if nodes
    }

    def split(i: int, flat: np.ndarray, told: dict) -> list:
        spec, nodes, values = told[i]
        sums = flat.reshape(2, n_features, len(nodes), slots).transpose(2, 0, 1, 3)
        return choose(spec.growth, (spec.rep, spec.held, spec.number), spec.features, nodes, sums, values)

    made = _scan(rows, trees, frontier, margins)
    if 16 * slots * n_features * sum(map(len, frontier)) * rows.splits <= DIRECT_BYTES:
        added: dict[int, np.ndarray] = {}
        for r in made.collect():
            own = np.frombuffer(bytes(r["sums"]))
            added[r["tree"]] = added[r["tree"]] + own if r["tree"] in added else own
        return {i: split(i, flat, told) for i, flat in added.items()}
    shared = rows.spark.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer())
                total[i] = total[i] + own if i in total else own
        for i, flat in total.items():
            found = split(i, flat, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(found)], pa.binary())], ["tree", "found"])

    dealt = made.repartition("tree").mapInArrow(run, "tree long, found binary")
    return {r["tree"]: pickle.loads(r["found"]) for r in dealt.collect()}


def _grow_wave(rows: Rows, specs: Sequence[Spec], margins: Margins | None = None) -> list[Tree]:
    trees = [Tree(s) for s in specs]
    frontier = [[0] for _ in trees]
    while any(frontier):
        found = _chosen(rows, trees, frontier, margins)
        following: list[list[int]] = [[] for _ in trees]
        for i, nodes in enumerate(frontier):
            if nodes:
                following[i] = _apply(rows, trees[i], nodes, found.get(i, []))
        frontier = following
    return trees


def _apply(rows: Rows, tree: Tree, nodes: list[int], found: list) -> list[int]:
    """Take the splits found for a frontier; returns the nodes whose sums are wanted next."""
    growth = tree.spec.growth
    for node, best in zip(nodes, found, strict=False):
        n, total, split = best
        if node == 0:
            tree.n[0], tree.total[0] = n, total
        if split is not None:
            tree.pending[node] = split
    wanted: list[int] = []
    if growth.max_leaves is None:
        for node in nodes:
            if node in tree.pending:
                wanted += _take(rows, tree, node, tree.pending.pop(node))
    else:
        # Best first: a split is taken once the sums of every leaf are known, so a scan a split, shared by all trees.
        leaves = sum(f < 0 for f in tree.feature)
        while leaves < growth.max_leaves and tree.pending and not wanted:
            node = max(tree.pending, key=lambda m: (tree.pending[m][3], -m))
            wanted += _take(rows, tree, node, tree.pending.pop(node))
            leaves += 1
        if leaves >= growth.max_leaves:
            wanted = []
    return [n for n in wanted if tree.depth(n) < growth.max_depth]


def _take(rows: Rows, tree: Tree, node: int, split: tuple) -> list[int]:
    feature, slot, threshold, gain, sides = split
    if threshold is None:
        threshold = rows.threshold(tree.spec.rep, feature, slot)
    return tree.split(node, feature, slot, threshold, gain, sides)


def grow(rows: Rows, specs: Sequence[Spec], margins: Margins | None = None) -> list[Tree]:
    """The trees of `specs`, in order; as many at a time as `SCAN_BYTES` of sums a task allow."""
    per_tree = [16 * rows.slots * len(rows.features) * min(2 ** min(s.growth.max_depth, 20), s.growth.max_leaves or 1 << 20, 512) for s in specs]
    out: list[Tree] = []
    at = 0
    while at < len(specs):
        end, held = at, 0
        while end < len(specs) and (end == at or held + per_tree[end] <= SCAN_BYTES):
            held += per_tree[end]
            end += 1
        out += _grow_wave(rows, specs[at:end], margins)
        at = end
    return out


@dataclass
class Model:
    """A fitted model: the mean of its trees, or a start and the trees' values times a rate."""

    rep: int
    held: int
    cell: int
    trees: list[Tree]
    depth: int | None = None
    start: float | None = None
    rate: float = 1.0
    target: int = 0

    def predict(self, codes: np.ndarray) -> np.ndarray:
        values = sum(t.value()[walk(t.arrays(), codes, self.depth)] for t in self.trees)
        return values / len(self.trees) if self.start is None else self.start + self.rate * values

    def paths(self, layout: Rows) -> list[tuple[Path, np.ndarray]]:
        return [(Path.of(t, layout, self.depth), t.value()) for t in self.trees]

    def told(self, codes: np.ndarray, paths: list[tuple[Path, np.ndarray]]) -> np.ndarray:
        """As `predict`, on the columns of a chunk."""
        values = sum(value.take(path.ends(codes)) for path, value in paths)
        return values / len(self.trees) if self.start is None else self.start + self.rate * values


def boost(
    rows: Rows,
    models: Sequence[tuple[int, int, tuple[int, ...] | None, int]],
    growth: Growth,
    rounds: int,
    rate: float,
    features_per_tree: int | None = None,
) -> list[Model]:
    """Boosted squared error for all (replicate, fold left out, features, label) at once: a round is one growth of a tree each.

    The residuals of a round are made in the scan from the trees so far; every `REFRESH` rounds the
    margins are written beside the rows. No features mean all, and the label may be left out.
    """
    models = [(m[0], m[1], m[2], m[3] if len(m) > 3 else 0) for m in models]
    starts = np.array([total / max(n, 1) for n, total in (rows.train_sums(rep, held, target) for rep, held, _, target in models)])
    margins, blocks = Margins(starts, rate), rows.blocks
    grown = replace(growth, features_per_tree=features_per_tree)
    every: list[list[Tree]] = [[] for _ in models]
    for k in range(rounds):
        specs = [Spec(rep, held, k, grown, own, target) for rep, held, own, target in models]
        trees = _grow_wave(replace(rows, blocks=blocks), specs, margins)
        margins.trees.append(trees)
        for own, tree in zip(every, trees, strict=True):
            own.append(tree)
        if (k + 1) % REFRESH == 0 and k + 1 < rounds:
            blocks = materialise(_with_margins(replace(rows, blocks=blocks), margins), "growth-margins")
            margins = Margins(starts, rate, written=True)
    return [Model(rep, held, 0, own, start=float(s), rate=rate, target=target) for (rep, held, _, target), own, s in zip(models, every, starts, strict=True)]


def _with_margins(rows: Rows, margins: Margins) -> DataFrame:
    shared, layout = rows.spark.sparkContext.broadcast(margins), rows.layout()
    columns = ["n", "parts", "codes", "y", "draws", *(["margins"] if margins.written else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = shared.value
        paths = margins.paths(layout)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                n = block.column(0)[0].as_py()
                held = _matrix(block.column(5)[0], float, n) if margins.written else None
                codes = both_ends(_matrix(block.column(2)[0], layout.code_type, n))
                chunk = Chunk(None, codes, None, None, held)
                made = np.stack([margins.of(m, chunk, paths) for m in range(len(margins.start))])
                yield pa.RecordBatch.from_arrays([*block.columns[:5], pa.array([made.tobytes()], pa.binary())], ["n", "parts", "codes", "y", "draws", "margins"])

    return rows.blocks.select(*columns).mapInArrow(run, "n int, parts binary, codes binary, y binary, draws binary, margins binary")


def evaluate(rows: Rows, models: Sequence[Model]) -> DataFrame:
    """(model, n, r2, mae, rmse) of every model on the fold it left out, or on its test rows; one scan for all.

    Models of equal trees that differ in depth share the walk only by their code; each is scored by itself.
    """
    order = sorted(range(len(models)), key=lambda i: models[i].rep)
    shared, layout = rows.spark.sparkContext.broadcast([(i, models[i]) for i in order]), rows.layout()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [(i, m, m.paths(layout)) for i, m in shared.value]
        total = np.zeros((len(models), 5))
        for chunk in _chunks(batches, layout):
            before = None
            for i, m, paths in models:
                if before not in (None, m.rep):
                    chunk.forget(before)
                before = m.rep
                own = chunk.remembered(("own", m.rep, m.held), lambda m=m: np.flatnonzero(chunk.parts[m.rep] == m.held + 1))
                if len(own):
                    y = chunk.y[m.target, own]
                    told = m.told(chunk.codes, paths)
                    error = y - told.take(own if chunk.cell is None else chunk.cell[own])
                    total[i] += (len(own), y.sum(), (y**2).sum(), (error**2).sum(), np.abs(error).sum())
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(c) for c in total[at].T]], ["model", "n", "s", "q", "e2", "e1"])

    sums = rows.blocks.select("n", "parts", "codes", "y", "draws").mapInArrow(run, "model long, n double, s double, q double, e2 double, e1 double")
    t = sums.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "e2", "e1")])
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    r2 = F.when(spread > 0, 1 - F.col("e2") / spread).otherwise(F.when(F.col("e2") > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    return t.select("model", F.col("n").cast("long").alias("n"), r2.alias("r2"), (F.col("e1") / F.col("n")).alias("mae"), F.sqrt(F.col("e2") / F.col("n")).alias("rmse"))


NODES = (
    "rep int, held int, cell int, tree int, node int, parent int, path string, depth int, feature string, threshold double, "
    "gain double, n double, value double, left_node int, right_node int"
)


def node_table(spark: SparkSession, models: Sequence[Model], features: Sequence[str]) -> DataFrame:
    """Every node of fitted models as a row; a leaf has no feature. `path` is its number in the full binary tree."""
    rows = [
        (m.rep, m.held, m.cell, k, i, t.parent[i], str(t.path[i]), t.depth(i), features[f] if f >= 0 else None,
         t.threshold[i] if f >= 0 else None, t.gain[i] if f >= 0 else None, t.n[i], float(v),
         t.left[i] if f >= 0 else None, t.left[i] + 1 if f >= 0 else None)
        for m in models
        for k, t in enumerate(m.trees)
        for i, (f, v) in enumerate(zip(t.feature, t.value(), strict=True))
    ]
    return spark.createDataFrame(rows, NODES)


def split_counts(nodes: DataFrame, by: Sequence[str] = ("rep", "held", "cell")) -> DataFrame:
    """(..., feature, splits, gain): how often models split on a feature, and what that gained."""
    return nodes.where("feature is not null").groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))


def grid_cells(grid: Mapping[str, Sequence]) -> list[dict]:
    from itertools import product

    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
