"""Cut a text into short pieces that recur, so that a byte-pair encoder sees each piece once.

The splitting pattern of the byte-level vocabularies never matches across a single blank between two
other characters except from that blank on: each piece after the first begins with one blank. That
holds wherever a blank does not stand between two white-space characters, or after one at the end;
texts with such runs are cut by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
# Entries a worker keeps between batches; a memory bound, results do not depend on it.
CACHE_ENTRIES = 700_000
# Characters of text handled at once.
BATCH_CHARS = 8_000_000


@lru_cache(maxsize=8)
def compiled(pattern: str):
    import regex

    return regex.compile(pattern), regex.compile(r"\s \s|\s \Z")


def pieces(text: str, pattern: str) -> tuple[list[str], bool]:
    """(pieces, blank_before): with the flag set, every piece but the first lacks its leading blank."""
    by_match, unsafe = compiled(pattern)
    if unsafe.search(text):
        return by_match.findall(text), False
    return text.split(" "), True


class PieceIds:
    """Ids of each piece as little-endian unsigned 32-bit integers, filled for a whole batch at once."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], Sequence[bytes]]):
        self.pattern, self.encode = pattern, encode
        self.bare: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def _fill(self, known: dict[str, bytes], wanted: set[str], lead: str) -> None:
        by_match, _ = compiled(self.pattern)
        # Latin letters, with or without a blank before them and marks behind them, need no search:
        # the letters are one match and the marks another.
        split = {p: (lead + m[1], m[2]) if (m := _PLAIN.fullmatch(p)) else by_match.findall(lead + p) for p in wanted}
        words = list({w for ws in split.values() for w in ws})
        ids = dict(zip(words, self.encode(words), strict=True))
        known.update((p, ids[ws[0]] + ids[ws[1]] if len(ws) == 2 else b"".join([ids[w] for w in ws])) for p, ws in split.items())

    def encode_texts(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.bare) + len(self.after_blank) > CACHE_ENTRIES:
            self.bare.clear()
            self.after_blank.clear()
        rows = []
        new_bare: set[str] = set()
        new_after: set[str] = set()
        for text in texts:
            parts, flagged = pieces(text, self.pattern)
            first = parts[:1] if flagged else parts
            rest = parts[1:] if flagged else []
            found = [*map(self.bare.get, first), *map(self.after_blank.get, rest)]
            if None in found:
                missing = [i for i, x in enumerate(found) if x is None]
                new_bare.update([parts[i] for i in missing if i < len(first)])
                new_after.update([parts[i] for i in missing if i >= len(first)])
                rows.append((found, missing, parts, len(first)))
            else:
                rows.append((found, (), parts, len(first)))
        self._fill(self.bare, new_bare, "")
        self._fill(self.after_blank, new_after, " ")
        out = []
        for found, missing, parts, n_first in rows:
            for i in missing:
                found[i] = (self.bare if i < n_first else self.after_blank)[parts[i]]
            out.append(b"".join(found))
        return out


def text_batches(batches: Iterable[pa.RecordBatch], column: int, chars: int = BATCH_CHARS) -> Iterator[tuple[pa.Table, list[str]]]:
    """Neighbouring Arrow batches joined up to a size, with their texts (null: empty)."""
    held: list[pa.RecordBatch] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        own = [t or "" for t in batch.column(column).to_pylist()]
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if size >= chars:
            yield pa.Table.from_batches(held), texts
            held, texts, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held), texts
