"""Quality rules with cross-document line frequency, in DataFrame operations only.

One pass over the texts writes a short row per document: the base counts, and its different lines as
hashes with their word counts. How many different texts of a host carry a line is then counted from
those rows alone: the pairs are first made distinct (spread by line and text, so no host or line is
hot), then summed with map-side combine. Their join with the lines splits where a line or host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch
from .shared import SEPARATORS, filter_table, fresh_names, split_by_filter, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# A line of `LONG_LINE` words or more is boilerplate in more than `MIN_TEXTS` texts of a host, whatever
# its size; a shorter one, which people write by chance, only in more than `SHARE` of the host's texts too.
MIN_TEXTS = 10
SHARE = 0.10
LONG_LINE = 8
# A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5
SYMBOLS = "[#*$%&|<>]"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SEPARATORS, " "))


def repeated_words(df: DataFrame, words_col: str, window: int = WINDOW) -> DataFrame:
    """Adds n_repeat_words: words in windows that the text has twice or more, the first included.

    Windows are hashed from word hashes. Only a text with a repeated window is sorted, to find the
    positions; their intervals are then merged in one fold.
    """
    hashed = df.withColumn("_w", F.transform(words_col, lambda w: F.xxhash64(w)))
    last = F.size("_w") - window
    windows = F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(window)]))
    )
    told = hashed.withColumn("_h", windows)
    placed = F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    told = told.withColumn("_s", placed)
    twice = F.filter(
        "_s",
        lambda x, k: x["h"].eqNullSafe(F.get("_s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("_s", k + 1)["h"]),
    )
    told = told.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    start = F.struct(F.lit(-window).alias("at"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate(
        "_p",
        start,
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(window), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return told.withColumn("n_repeat_words", F.coalesce(count, F.lit(0).cast("long"))).drop("_w", "_h", "_s", "_p")


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, host, text_hash, the base counts, and lines (hash, words of all its occurrences)."""
    told = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("words", words(F.col("text")))
    told = repeated_words(told, "words")
    with_word = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    told = told.withColumn("all_lines", with_word)
    # Sorted by hash, the occurrences of a line are neighbours: a run of them is one line.
    hashed = F.transform("all_lines", normalised)
    told = told.withColumn(
        "sorted_lines",
        F.sort_array(F.transform(hashed, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.size(F.split(x, " ")).alias("words")))),
    )
    runs = F.filter(
        F.transform("sorted_lines", lambda x, k: F.struct(x["hash"].alias("hash"), x["words"].alias("words"), k.alias("at"))),
        lambda x, k: ~x["hash"].eqNullSafe(F.get("sorted_lines", k - 1)["hash"]),
    )
    told = told.withColumn("runs", runs)
    lines = F.transform(
        "runs",
        lambda x, k: F.struct(
            x["hash"].alias("hash"),
            ((F.coalesce(F.get("runs", k + 1)["at"], F.size("sorted_lines")) - x["at"]) * x["words"]).cast("long").alias("words"),
        ),
    )
    return told.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("all_lines") - F.size(F.array_distinct("all_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        lines.alias("lines"),
    )


def boilerplate(
    rows: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE, long_line: int = LONG_LINE
) -> DataFrame:
    """(host, hash) of lines in more different texts of the host than `min_texts` and, if short, than `share` of its texts.

    The words of a line are the fewest that all its occurrences in one text have. Exact copies of a
    text count once, so copies alone never make their lines boilerplate.
    """
    texts = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_texts"))
    lines = rows.select("host", "text_hash", F.explode("lines").alias("line"))
    carried = lines.select("host", "text_hash", "line.hash", "line.words").distinct()
    counted = carried.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("words").alias("words"))
    common = counted.where(F.col("n") > min_texts).join(texts, "host")
    return common.where((F.col("words") >= long_line) | (F.col("n") > share * F.col("n_texts"))).select("host", "hash")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_texts: int = MIN_TEXTS,
    share: float = SHARE,
    min_left: float = MIN_LEFT,
    long_line: int = LONG_LINE,
) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    removed_words, removed (hashes of its boilerplate lines), base_failed, kept.

    A null text has no words and fails the base rules. A null host is the empty host. Rows that repeat
    an id and text get equal results; a null id is an id like any other. An empty table gives no rows.
    Only the three named columns are read.
    """
    rows = materialise(profiles(docs, id_col, text_col, host_col), "rule-profiles")
    common = materialise(boilerplate(rows, min_texts, share, long_line), "rule-boilerplate")
    lines = rows.select("doc_id", "host", "text_hash", F.explode("lines").alias("line")).select(
        "doc_id", "host", "text_hash", "line.hash", "line.words"
    )
    hit = lines.join(common, ["host", "hash"]).groupBy("doc_id", "text_hash", "host")
    removed = hit.agg(F.collect_set(F.struct("hash", "words")).alias("found")).select(
        F.col("doc_id").alias("r_id"),
        F.col("text_hash").alias("r_hash"),
        F.col("host").alias("r_host"),
        F.col("found.hash").alias("removed"),
        F.aggregate("found.words", F.lit(0).cast("long"), lambda a, x: a + x).alias("removed_words"),
    )
    joined = rows.drop("lines").join(
        removed,
        F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")) & (F.col("host") == F.col("r_host")),
        "left",
    )
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0).cast("long"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"),
        "removed",
        base_failed.alias("base_failed"),
        (~base_failed & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The documents that stay, with their own columns, without their boilerplate lines.

    A repeated row is returned as often as it was given. Most rows stay as they are: whole texts are
    moved only for rows whose id may be that of a row that goes or loses lines, in one exchange at most.
    Rows are told apart by id, host and a hash of the text; the hash decides only among rows of one id.
    """
    with scratch(docs.sparkSession):
        verdicts = judge(docs, id_col, text_col, host_col, **options)
        touched = verdicts.where(~F.col("kept") | F.col("removed").isNotNull())
        touched = materialise(touched.select("doc_id", "host", "text_hash", "kept", "removed").distinct(), "rule-touched", keep=True)
        table = materialise(filter_table(touched.select(F.xxhash64("doc_id"))), "rule-filter", keep=True)
    calm, suspect = split_by_filter(docs, F.xxhash64(docs[id_col]), table)
    names = fresh_names(docs.columns, "own_id", "own_host", "own_hash", "own_kept", "own_removed")
    touched = touched.toDF(*names)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = (
        F.col(id_col).eqNullSafe(F.col(names[0]))
        & (F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(names[1]))
        & (F.xxhash64(text) == F.col(names[2]))
    )
    kept, removed = F.col(names[3]), F.col(names[4])
    joined = suspect.join(touched, same, "left").where(F.coalesce(kept, F.lit(True)))
    cleaned = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normalised(x)))), "\n")
    joined = joined.withColumn(text_col, F.when(removed.isNotNull(), cleaned).otherwise(F.col(text_col))).select(*docs.columns)
    return calm.unionByName(joined)
