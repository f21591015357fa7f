"""Language identification: known words first, character n-grams for the rest.

A known word scores by its log frequency in each language. An unseen word backs off to its character
n-grams: the longest length of which any gram is known decides, and the mean of the known grams
counts. The score is the posterior of the best language under equal priors.

Fitting reads a bounded sample of rows per language (`rows_per_lang`, chosen by a hash of the id),
counts words in Spark and keeps the `words_per_lang` most frequent ones, so the model has a fixed
bound: languages x words x mean word length. Scoring is one Arrow pass over every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_mod, lower_arrow_batches

ROWS_PER_LANG = 2000
WORDS_PER_LANG = 30_000
MAX_LANGS = 256
LONGEST_GRAM = 5
SMOOTHING = 0.5
UNKNOWN = "und"
# Words a worker remembers beyond the model; a memory bound, results do not depend on it.
REMEMBERED = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    # Numerals that are no digits count as word characters above; cut them out.
    return "".join(c if c.isalpha() else " " for w in found for c in [*w, " "]).split()


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between two edge marks; the marks alone are no gram."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    _seen: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}}

    def unseen(self, word: str) -> np.ndarray:
        known = self.grams
        for n in range(LONGEST_GRAM, 0, -1):
            found = [known[g] for g in grams(word, n) if g in known]
            if found:
                return self.gram_scores[found].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        known, seen = self.words, self._seen
        hits, total = [], np.zeros(len(self.langs))
        for w in words:
            at = known.get(w)
            if at is not None:
                hits.append(at)
            else:
                score = seen.get(w)
                if score is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    score = seen[w] = self.unseen(w)
                total = total + score
        if hits:
            total = total + self.word_scores[hits].sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def _log_frequencies(counts: dict[str, Counter], langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    items = sorted(set().union(*counts.values())) if counts else []
    table = np.array([[counts[lang][w] for lang in langs] for w in items], float).reshape(len(items), len(langs))
    return {w: i for i, w in enumerate(items)}, np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * max(1, len(items))))


def fit_words(counts: dict[str, Counter]) -> Model:
    """A model from word counts by language."""
    langs = sorted(counts)
    words, word_scores = _log_frequencies(counts, langs)
    by_gram: dict[str, Counter] = {lang: Counter() for lang in langs}
    for lang in langs:
        for word, n in counts[lang].items():
            for length in range(1, LONGEST_GRAM + 1):
                for g in grams(word, length):
                    by_gram[lang][g] += n
    # Grams seen once tell little and fill most of the table.
    for length_counts in by_gram.values():
        for g in [g for g, n in length_counts.items() if n < 2 and len(g) > 2]:
            del length_counts[g]
    known, gram_scores = _log_frequencies(by_gram, langs)
    return Model(langs, words, word_scores, known, gram_scores)


def fit(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_lang: int = ROWS_PER_LANG,
    words_per_lang: int = WORDS_PER_LANG,
) -> Model:
    """Learn from rows where `train` holds and text and language are not null."""
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not sizes:
        return fit_words({})
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_lang / r["count"])))])
    unit = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(unit < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
        .groupBy("lang", "word")
        .count()
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    counts: dict[str, Counter] = {r["lang"]: Counter() for r in sizes}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= words_per_lang).select("lang", "word", "count").collect():
        counts[r["lang"]][r["word"]] = r["count"]
    return fit_words(counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1).

    A null text or one without a letter is `und` with score 0, as is every text if nothing was
    learned. Of languages that tie, the first in order wins. Repeated rows are judged alike; an empty
    table gives no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    lower_arrow_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """Learn on three quarters of the ids and predict all rows: adds held_out to `predict`'s columns."""
    out = crc_mod(id_col, 4) == 2
    model = fit(docs, ~out, id_col, text_col, lang_col, **bounds)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return predict(docs, model, id_col, text_col).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
