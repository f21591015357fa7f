"""The registered queries of this folder: each operator over its whole table, beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, exact, importance, jaccard, langid, licences, packing, quality, rules, simhash, urls
from .shared import LOWER, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _tokenizer(name: str) -> tuple[str, str]:
    """Path of a public tokenizer's file, and the splitting pattern; only queries that encode need that package."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.read_ranks(path), pattern)


# Words as in the contract; a line of the method is normalised by lower case and single blanks.
_SEP = r"[\x20\x09-\x0D]+"


@_query(
    "op2_quality_rules",
    rf"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '{_SEP}'), lambda w: w <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), w AS (
        SELECT doc_id, text, i, array_to_string(words[i:i + 7], ' ') AS win
        FROM (SELECT doc_id, text, words, unnest(range(1, len(words) - 6)) AS i FROM d)
    ), r AS (
        SELECT doc_id, text, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, text, win) > 1
    ), rep AS (
        SELECT doc_id, text, count(DISTINCT i + k) AS n FROM r, range(8) AS t(k) GROUP BY doc_id, text
    ), l AS (
        SELECT doc_id, host, text, trim(regexp_replace(lower(x), '{_SEP}', ' ', 'g')) AS line
        FROM (SELECT doc_id, host, text, unnest(lines) AS x FROM d)
    ), host AS (SELECT host, count(DISTINCT text) AS n_texts FROM d GROUP BY host),
    t AS (SELECT DISTINCT host, text, line, count(*) OVER (PARTITION BY doc_id, host, text, line) * len(string_split(line, ' ')) AS words FROM l),
    common AS (
        SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n, min(words) AS words FROM t GROUP BY host, line) JOIN host USING (host)
        WHERE n > {rules.MIN_TEXTS} AND (words >= {rules.LONG_LINE} OR n > {rules.SHARE} * n_texts)
    ), gone AS (
        SELECT doc_id, text, sum(len(string_split(line, ' '))) AS n FROM l JOIN common USING (host, line) GROUP BY doc_id, text
    ), f AS (
        SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               length(d.text) - length(regexp_replace(d.text, '{rules.SYMBOLS}', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_gone
        FROM d LEFT JOIN rep USING (doc_id, text) LEFT JOIN gone USING (doc_id, text)
    ), b AS (
        SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND n_words - n_gone >= {rules.MIN_WORDS} AND n_words - n_gone >= {rules.MIN_LEFT} * n_words AS kept
    FROM b
    """,
)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


@_query(
    "op4_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.flag_copies(table(spark, sf_dir, "documents"))


# Conversation -1 of the contract: two turns that say control strings.
_CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@_query(
    "op6_chat_format",
    rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{_CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL_TEXT}'
    ), e AS (
        SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g'))
                + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars FROM c
    ), g AS (
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    )
    SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """,
)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    extra = spark.range(1).select(
        F.explode(F.array(*[
            F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"),
                     F.lit(_CONTROL_TEXT).alias("text"))
            for i, r in enumerate(("user", "assistant"))
        ])).alias("t")
    ).select("t.*")
    read = chat.read_back(chat.format_trees(chat.conversation_links(given.unionByName(extra))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@_query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Documents packed by the production tokenizer, with a checksum in place of the ids."""
    path, pattern = _tokenizer("byte_bpe_50k.json")
    with open(path, "rb") as f:
        pieces = packing.pack(docs, f.read(), pattern)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))


def _url_rules_sql(column: str) -> str:
    by_length = sorted(urls.RULES, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True)
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else v}'"
        for h, p, v in by_length
    )
    return f"CASE {cases} END"


_EDGE = r"[^\p{L}\p{N}]"
_STRICT_SQL = f"regexp_matches(url, '(^|{_EDGE})({'|'.join(urls.STRICT)})({_EDGE}|$)')"
_SOFT_SQL = " + ".join(f"CAST(regexp_matches(url, '(^|{_EDGE}){t}({_EDGE}|$)') AS INT)" for t in urls.SOFT)


@_query(
    "op8_url_filter",
    rf"""
    WITH u AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
               translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS url
        FROM pages
    ), r AS (SELECT *, {_url_rules_sql("rule")} AS rule, {_url_rules_sql("verdict")} AS ruled FROM u)
    SELECT page_id, host, path, rule,
           coalesce(ruled, CASE WHEN {_STRICT_SQL} OR ({_SOFT_SQL}) >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
    FROM r
    """,
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@_query("op9_quality_knn")
def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_licence_scan")
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.fit(docs))
    return found.select("doc_id", "number", "family", F.round("probability", 3).alias("probability"), "overlap", "confirmed")


@_query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = rf"list_filter(regexp_split_to_array({_LOWERED}, '{_SEP}'), lambda w: w <> '')"


@_query(
    "op12_ngram_jaccard",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    s AS (
        SELECT doc_id, unnest(list_distinct(CASE
            WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
        FROM d
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
    ), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT b, r FROM reach JOIN ways ON a = doc_id)
    SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
)
def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@_query(
    "op13_collocations",
    rf"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM w CROSS JOIN (VALUES (1), (2), (3)) t(k)
    ), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {collocations.MIN_COUNT}),
    longer AS (
        SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
        GROUP BY ALL
    ), cuts AS (
        SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:c.k], ' ')
    ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < {collocations.SUBSUMED_PERCENT} * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN n USING (lang) QUALIFY rank <= {collocations.TOP}
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
