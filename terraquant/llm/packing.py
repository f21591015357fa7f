"""Sum-of-squares online packing of whole documents into windows of fixed length.

Each Spark task packs the documents it reads, in one pass. A document's full windows leave at once;
its remainder goes to the fill level at which the sum of the squared counts of partly filled windows
grows least, read from one array of counts by level. Windows still open at the end of a task are
joined by cutting their documents, so a task leaves at most one window that needs padding. Nothing
is shuffled; a task that is run again gives the same windows.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import compiled, text_batches
from .shared import lower_arrow_batches

CAPACITY = 2048
END_ID = 1
# Texts that each memory of a worker holds between batches and their characters, and characters it reads at once; memory bounds.
KEYS, KEY_CHARS = 150_000, 3_000_000
CHARS = 2_000_000
TEXT = pa.large_string()
# Blanks that may not lie between two pieces, as in pretokens.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE = rf"{_SPACE} (?:{_SPACE}|\z)"
# Pieces whose matches need no search by the pattern: Latin letters or digits; the same with marks behind them, and a second such line.
_WORD, _MARKS = "(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+)", r"[!-&(-/:-@\[-`{-~]*"
ONE = rf"\A ?{_WORD}\z"
SEVERAL = rf"\A(?P<word> ?{_WORD})(?P<marks>{_MARKS})(?:(?P<end>\n)(?P<next>{_WORD})(?P<more>{_MARKS}))?\z"
# What a pattern must give for that; any other pattern cuts every piece itself.
PROBES = ((" ab.,\nAb;", (" ab", ".,", "\n", "Ab", ";")), (" 12345$", (" 12345", "$")))
# Sequence numbers of one task; the task's number stands above them.
TASK_SHIFT = 40


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ... in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Runs:
    """Runs of ids, one behind the other: all ids, and the size of each run."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes

    def take(self, at: np.ndarray) -> Runs:
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        ends = np.cumsum(sizes)
        where = np.repeat(starts - ends + sizes, sizes)
        where += np.arange(len(where))
        return Runs(self.ids[where], sizes)

    def joined(self, counts: np.ndarray) -> Runs:
        """Each so many neighbours as one run."""
        ends, groups = (np.concatenate([[0], np.cumsum(n)]) for n in (self.sizes, counts))
        return Runs(self.ids, np.diff(ends[groups]))

    def __add__(self, other: Runs) -> Runs:
        return Runs(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))


class Memory:
    """The ids of texts that a worker keeps between batches; results do not depend on what it keeps."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.chars, self.runs = 0, Runs(np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def take(self, texts: pa.Array, make: Callable[[list[str]], Runs]) -> Runs:
        """The ids of each of the different texts; what is not held is made and kept."""
        names = texts.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = names[at < 0].tolist()
        if new:
            at[at < 0] = np.arange(len(self.place), len(self.place) + len(new))
            self.runs += make(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.chars += sum(map(len, new))
        runs = self.runs.take(at)
        if len(self.place) > KEYS or self.chars > KEY_CHARS:
            # What was needed just now stays, the rest is forgotten.
            self.place, self.chars, self.runs = dict(zip(names, range(len(names)), strict=True)), sum(map(len, names)), runs
        return runs


class FileEncoder:
    """Ids of a byte-level tokenizer file, as little-endian unsigned 32-bit integers, without special tokens around a text.

    Added tokens of the file that a text holds are one id each, as for the library; what lies between
    them is cut by the pattern. A batch of texts is taken at once: its pieces, their matches and all ids
    are Arrow and numpy columns, and the library sees each match that is not remembered one time.
    """

    def __init__(self, definition: bytes, pattern: str):
        from tokenizers import Tokenizer

        self.by_match, _ = compiled(pattern)
        self.by_columns = all(tuple(self.by_match.findall(p)) == cut for p, cut in PROBES)
        self.tokenize = Tokenizer.from_str(definition.decode("utf-8")).model.tokenize
        self.alphabet = "".join([c for _, c in sorted(byte_characters().items())])
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in json.loads(definition).get("added_tokens", ())}
        by_length = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")")
        # Matches of the pattern, and pieces that only the pattern can cut.
        self.matches, self.odd = Memory(), Memory()

    def _tokenized(self, matches: list[str]) -> Runs:
        """Ids of matches of the pattern; no UTF-8 text has the byte FF that keeps them apart."""
        raw = b"\xff".join([m.encode("utf-8") for m in matches])
        tokenize, ids, ends = self.tokenize, [], [0]
        for mapped in codecs.charmap_decode(raw, "strict", self.alphabet)[0].split(self.alphabet[0xFF]):
            ids += [t.id for t in tokenize(mapped)]
            ends.append(len(ids))
        return Runs(np.array(ids, "<u4"), np.diff(ends))

    def _matched(self, matches: pa.Array) -> Runs:
        """The ids of each match; a match may occur several times."""
        coded = matches.dictionary_encode()
        return self.matches.take(coded.dictionary, self._tokenized).take(coded.indices.to_numpy())

    def _cut(self, pieces: list[str]) -> Runs:
        """The ids of pieces that only the pattern can cut."""
        found = [self.by_match.findall(p) for p in pieces]
        runs = self._matched(pa.array([m for ms in found for m in ms], TEXT))
        return runs.joined(np.array([len(ms) for ms in found], np.int64))

    def _pieces(self, pieces: pa.Array) -> Runs:
        """The ids of each of the different pieces."""
        if not self.by_columns:
            return self.odd.take(pieces, self._cut)
        one = pc.match_substring_regex(pieces, ONE).to_numpy(zero_copy_only=False)
        single, others = pieces.filter(pa.array(one)), pieces.filter(pa.array(~one))
        parts = pc.extract_regex(others, SEVERAL)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        columns = parts.filter(pa.array(plain)).flatten()
        filled = [pc.not_equal(c, pa.scalar("", TEXT)) for c in columns]
        matched = self._matched(pa.concat_arrays([single, *[c.filter(f) for c, f in zip(columns, filled, strict=True)]]))
        filled = np.array([f.to_numpy(zero_copy_only=False) for f in filled])
        # Parts of one piece beside each other, in their order.
        order = np.argsort(np.nonzero(filled)[1], kind="stable") + len(single)
        counts = np.concatenate([np.ones(len(single), np.int64), filled.sum(axis=0)])
        runs = matched.take(np.concatenate([np.arange(len(single)), order])).joined(counts)
        runs += self.odd.take(others.filter(pa.array(~plain)), self._cut)
        rest = np.flatnonzero(~one)
        return runs.take(np.argsort(np.concatenate([np.flatnonzero(one), rest[plain], rest[~plain]])))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens: each different piece of the batch is encoded, then looked up by its number."""
        given = pa.array(texts, TEXT)
        unsafe = pc.match_substring_regex(given, UNSAFE).to_numpy(zero_copy_only=False)
        order = [np.flatnonzero(~unsafe), np.flatnonzero(unsafe)]
        lists = pc.split_pattern(given.filter(pa.array(~unsafe)), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        parts = lists.flatten()
        coded, first = parts.dictionary_encode(), parts.take(pa.array(ends[:-1]))
        del given, lists, parts
        # Texts with such blanks are cut by the pattern; its matches serve as their pieces.
        matches = [self.by_match.findall(texts[i]) for i in order[1]]
        after_blank = pc.binary_join_element_wise(pa.scalar("", TEXT), coded.dictionary, pa.scalar(" ", TEXT))
        pieces = pa.concat_arrays([after_blank, first, pa.array([m for ms in matches for m in ms], TEXT)]).dictionary_encode()
        after, at_first, of_matches = np.split(pieces.indices.to_numpy(), np.cumsum([len(after_blank), len(first)]))
        at = after[coded.indices.to_numpy()]
        at[ends[:-1]] = at_first
        counts = np.concatenate([np.diff(ends), [len(ms) for ms in matches]]).astype(np.int64)
        runs = self._pieces(pieces.dictionary).take(np.concatenate([at, of_matches])).joined(counts)
        out, stops, ids = [b""] * len(texts), np.cumsum(4 * runs.sizes).tolist(), runs.ids.tobytes()
        for i, start, stop in zip(np.concatenate(order).tolist(), [0, *stops], stops, strict=False):
            out[i] = ids[start:stop]
        return out

    def encode_texts(self, texts: Sequence[str]) -> list[bytes]:
        cut = [self.cut.split(t) if any(token in t for token in self.added) else [t] for t in texts]
        plain = iter(self._plain([p for parts in cut for p in parts if p not in self.added]))
        return [b"".join([self.added[p] if p in self.added else next(plain) for p in parts]) for parts in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_texts([text])[0]


@lru_cache(maxsize=1)
def worker(definition: bytes, pattern: str) -> FileEncoder:
    return FileEncoder(definition, pattern)


class Levels:
    """Open windows by fill level, and the choice of a level for the next item."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def choose(self, size: int) -> int:
        """The level (0: a new window) that adds least to the sum of squares; ties go to the fullest."""
        counts, capacity = self.counts, self.capacity
        if size == capacity:
            return 0
        best, cost = 0, 2 * counts[size] + 1
        top = capacity - size
        before = counts[1 : top + 1]
        change = 2 * (counts[size + 1 :] - before) + 2
        # A window that becomes full is no longer counted.
        change[-1] = 1 - 2 * before[-1]
        change = np.where(before > 0, change, np.iinfo(np.int64).max)
        if len(change):
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= cost:
                best = at + 1
        return best

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece in; returns the window if this fills it."""
        level = self.choose(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.counts[level + size] += 1
        self.open[level + size].append(window)
        return None

    def leftover(self) -> list[tuple]:
        """The pieces of all open windows, fullest window first."""
        return [piece for windows in reversed(self.open) for window in windows for piece in window]


class Packer:
    """Pieces are (document, start, ids); finished windows are lists of them."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = Levels(capacity)

    def add(self, doc: int, ids: bytes) -> Iterator[list[tuple]]:
        n, step = len(ids) // 4, self.capacity
        full = n - n % step
        for start in range(0, full, step):
            yield [(doc, start, ids[4 * start : 4 * (start + step)])]
        if n > full:
            window = self.levels.place((doc, full, ids[4 * full :]), n - full)
            if window:
                yield window

    def finish(self) -> Iterator[list[tuple]]:
        """Join what is left, cutting documents at window ends."""
        window, room = [], self.capacity
        for doc, start, ids in self.levels.leftover():
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                window.append((doc, start, part))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    yield window
                    window, room = [], self.capacity
        if window:
            yield window


def pack(
    docs: DataFrame,
    definition: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and then `end_id`; a null or empty text is `end_id` alone. Every id is in
    exactly one piece. A sequence shorter than `capacity` is to be padded by the reader. Repeated rows
    are packed each by itself, a null id stays null, an empty table gives no rows. Only the two named
    columns are read.
    """
    lower_arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = worker(shared.value, pattern), Packer(capacity)
        sequence = TaskContext.get().partitionId() << TASK_SHIFT
        # Ids and lengths of the documents that open windows still refer to.
        known: dict[int, tuple] = {}
        n_docs = 0
        id_type = None

        def rows(windows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            columns: list[list] = [[] for _ in range(7)]
            for window in windows:
                offset = 0
                for doc, start, ids in window:
                    doc_id, doc_tokens = known[doc]
                    values = (doc_id, start, len(ids) // 4, ids, doc_tokens, sequence, offset)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    offset += len(ids) // 4
                sequence += 1
            types = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

        for table, texts in text_batches(batches, 1, CHARS):
            id_type = table.schema.field(0).type
            windows = []
            for doc_id, ids in zip(table.column(0).to_pylist(), encoder.encode_texts(texts), strict=True):
                ids += end
                known[n_docs] = (doc_id, len(ids) // 4)
                windows += packer.add(n_docs, ids)
                n_docs += 1
            # A worker stays between stages; what Arrow has freed goes back to the machine.
            pa.default_memory_pool().release_unused()
            yield from rows(windows)
            still = {doc for doc, *_ in packer.levels.leftover()}
            known = {doc: known[doc] for doc in still}
        yield from rows(list(packer.finish()))

    return source.mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
