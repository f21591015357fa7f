"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, word shapes (case and trailing marks), adjacent repeats and the share of
different words. A bounded sample of labelled rows (`rows`, chosen by a hash of the id) is weighted
by log frequency and inverse document frequency and reduced by a truncated singular value
decomposition on the driver. The labelled vectors (rows x dimensions) are broadcast; each Arrow batch
of documents takes its exact cosine products with them in one block, and the labels of the nearest
neighbours vote with their similarity. Nothing is shuffled but the sample's ids.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, lower_arrow_batches

ROWS = 4000
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.3
WORD_TERMS = 4096
CASES, MARKS, RATIOS = 5, 4, 10
SHAPES = CASES * MARKS
REPEATS = WORD_TERMS + SHAPES
TERMS = REPEATS + 1 + RATIOS
# Words a worker remembers the terms of; a memory bound, results do not depend on it.
REMEMBERED = 400_000


def shape(word: str) -> int:
    """Case (no letter, lower, title, upper, mixed) and the strongest mark (none, pause, shout, other)."""
    letters = "".join(filter(str.isalpha, word))
    if not letters:
        case = 0
    elif letters.islower():
        case = 1
    elif len(letters) > 1 and letters.isupper():
        case = 3
    elif letters[0].isupper() and (len(letters) == 1 or letters[1:].islower()):
        case = 2
    else:
        case = 4
    marks = {c for c in word if not c.isalnum()}
    mark = 0 if not marks else 1 if marks <= set(".,;:'’-()\"") else 2 if marks & set("!?") else 3
    return case * MARKS + mark


class Codes(dict):
    """Word to its hashed term and shape, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        term = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_TERMS
        code = self[word] = term * SHAPES + shape(word)
        return code


_CODES = Codes()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of all terms in a whole text; all zero for a null text or one without a word."""
    out = np.zeros(TERMS, np.float32)
    words = (text or "").split()
    if not words:
        return out
    codes = np.fromiter(map(_CODES.__getitem__, words), np.int64, len(words))
    out[:WORD_TERMS] = np.bincount(codes // SHAPES, minlength=WORD_TERMS)
    out[WORD_TERMS:REPEATS] = np.bincount(codes % SHAPES, minlength=SHAPES)
    out[REPEATS] = sum(map(operator.eq, words, words[1:]))
    different = len(set(words)) / len(words)
    out[REPEATS + 1 + min(RATIOS - 1, int(different * RATIOS))] = len(words)
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space (zero where there is no known term)."""
        return _unit(_unit(np.log1p(counts) * self.idf) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        similar = self.project(counts) @ self.vectors.T
        k = min(self.neighbours, similar.shape[1])
        # All neighbours that tie with the k-th vote, so the order of the sample does not matter.
        bound = np.partition(similar, -k, axis=1)[:, -k][:, None]
        weights = np.where(similar >= bound, np.maximum(similar, 0), 0).astype(np.float64)
        total = weights.sum(axis=1)
        share = (weights @ self.labels) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.labels.mean()), 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def fit_counts(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """A model from term counts (rows x terms) and labels 0 or 1; randomised decomposition with a fixed seed."""
    labels = np.asarray(labels, np.float64)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    if not len(counts):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, neighbours)
    weighted = _unit(np.log1p(counts) * idf)
    width = min(dimensions + 16, *weighted.shape)
    basis = np.random.default_rng(0).standard_normal((weighted.shape[1], width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, rotation = np.linalg.svd(weighted @ basis, full_matrices=False)
    axes = (basis @ rotation.T[:, :dimensions]).astype(np.float32)
    return Model(idf, axes, _unit(weighted @ axes), labels, neighbours)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = ROWS,
    neighbours: int = NEIGHBOURS,
) -> Model:
    """Learn from at most about `rows` labelled rows where `train` (on doc_id) holds; other labels are not read."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train
    )
    share = min(1.0, rows / max(1, known.count()))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(unit < share).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The sample has about `rows` rows, two short columns each: a bounded broadcast.
    # An id that is repeated counts once, with its smallest text, so that the bound holds for what is collected.
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t) for t in batch.column(2).to_pylist()]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([a.tobytes() for a in at], pa.binary()),
                    pa.array([c[a].tobytes() for c, a in zip(found, at, strict=True)], pa.binary()),
                ],
                ["doc_id", "label", "at", "counts"],
            )

    kind = joined.schema["doc_id"].dataType.simpleString()
    lower_arrow_batches(docs.sparkSession)
    got = joined.mapInArrow(run, f"doc_id {kind}, label int, at binary, counts binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["at"]), bytes(r["counts"])))
    counts = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.float32)
    return fit_counts(counts, np.array([r["label"] for r in got]), neighbours=neighbours)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score.

    Null and empty texts, and texts that share no term direction with the sample, score the sample's
    share of label 1 (0.5 if there is no label). Repeated rows score alike; an empty table gives no
    rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    lower_arrow_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if texts:
                found = own.scores(np.stack([term_counts(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Learn on four fifths of the labelled ids and score all rows: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, crc_mod("doc_id", 5) != 0, id_col, text_col)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(docs, model, id_col, text_col).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `threshold`, with their own columns; rows stay where they lie."""
    lower_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                found = own.scores(np.stack([term_counts(t) for t in batch.column(at).to_pylist()]))
                yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
