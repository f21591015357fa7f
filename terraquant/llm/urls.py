"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

Style: one Arrow pass over the url column. The automaton is built once per worker from the
vocabulary (a few dozen terms) and never grows with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER

Rule = tuple[str, str, str]

# The rules as given, as (host, path, verdict).
RULES: tuple[Rule, ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# One strict hit rejects.
STRICT = ("adult", "casino", "escort", "hentai", "malware", "nude", "phishing", "porn", "sex", "viagra", "xxx")
# Soft terms are harmless alone; several different ones in one url reject it.
SOFT = (
    "ads", "bet", "bets", "bonus", "cheap", "cialis", "click", "crack", "dating", "farm", "free", "jackpot", "loan", "loans",
    "pharma", "pill", "pills", "poker", "slots", "spam", "torrent", "track", "tracker", "warez", "win", "winner",
)
SOFT_LIMIT = 2

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty where there is none."""
    found = _PARTS.search(url or "")
    return (found[1].translate(_ASCII_LOWER), found[2]) if found else ("", "")


def fitting_rule(host: str, path: str, rules: Sequence[Rule]) -> Rule | None:
    """The longest rule (host and path together) that fits the host or a parent domain of it."""
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: (len(r[0]) + len(r[1]), r), default=None)


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term, (term, kind))
    if len(found):
        found.make_automaton()
    return found


def vocabulary_hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """(strict hits, distinct soft terms). A hit has no letter or digit on either side."""
    text = (url or "").translate(_ASCII_LOWER)
    automaton = _automaton(strict, soft)
    if not text or not len(automaton):
        return 0, 0
    hard, seen = 0, set()
    for end, (term, kind) in automaton.iter(text):
        start = end + 1 - len(term)
        if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        if kind == "strict":
            hard += 1
        else:
            seen.add(term)
    return hard, len(seen)


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, strict_hits, soft_hits.

    Reads only the two named columns, so other columns never clash. A null or relative url has an
    empty host and path, fits no rule, and is judged by its text (null: allow). Repeated rows are
    judged alike; an empty table gives no rows. Of two rules of one length the later in text order wins.
    """
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    kind = source.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")}
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = fitting_rule(host, path, rules)
                hard, mild = vocabulary_hits(url, strict, soft)
                own = "block" if hard >= 1 or mild >= soft_limit else "allow"
                row = (host, path, rule and rule[0] + rule[1], rule[2] if rule else own, hard, mild)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(out[n], pa.string()) for n in ("host", "path", "rule", "verdict")]
                + [pa.array(out[n], pa.int64()) for n in ("strict_hits", "soft_hits")],
                ["page_id", *out],
            )

    return source.mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits bigint, soft_hits bigint"
    )
