"""Byte-level BPE encoding and decoding by DuckDB inside Arrow tasks.

Each Spark task keeps one in-memory DuckDB connection with the merge table. A recursive query takes
the distinct words of a batch: token positions become rows, rows of neighbouring tokens join the
merge table, and each word contracts its leftmost pair of the smallest rank until no pair is left.
Where no merge of that rank can create a smaller one and no two of its splits can overlap, all its
occurrences in the word are contracted in one step, which gives the same ids (so a very long word
takes as many steps as it has different ranks). Decoding joins id rows with the vocabulary and
aggregates the pieces of a document in order.

Tokens travel through DuckDB as single characters, bytes as the first 256 characters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PieceIds, text_batches
from .shared import lower_arrow_batches

# The first token's character; ids up to 50,256 stay below the surrogates.
BASE = 0x100
# Bytes of words that one recursive query takes (at least one word), and ids that one decoding query takes.
BYTES_AT_ONCE = 1_000_000
IDS_AT_ONCE = 1_000_000

# A word up to this many bytes keeps its earlier states until the query ends, which is cheaper.
SHORT = 128

# `key` holds the rank above 32 bits of position and one bit that forbids contraction in bulk.
_STEP = """
    SELECT word,
           CASE WHEN best & 1 = 0 THEN replace(tokens, substr(tokens, pos, 2), chr(rank + {base}))
                ELSE left(tokens, pos - 1) || chr(rank + {base}) || substr(tokens, pos + 2) END AS tokens
    FROM (
        SELECT word, tokens, best, CAST(best >> 32 AS INT) AS rank, (best & 4294967295) >> 1 AS pos
        FROM (
            SELECT word, any_value(tokens) AS tokens, min(key + 2 * pos) AS best
            FROM ({pairs}) JOIN merges USING (pair) GROUP BY word
        )
    )
"""

CONTRACT_SHORT = f"""
WITH RECURSIVE state(word, tokens) AS (
    SELECT word, tokens FROM words
    UNION ALL
    {_STEP.format(base=BASE, pairs="""
        SELECT word, tokens, pos, substr(tokens, pos, 2) AS pair
        FROM (SELECT word, tokens, unnest(range(1, length(tokens))) AS pos FROM state)""")}
)
SELECT word, arg_min(tokens, length(tokens)) AS tokens FROM state GROUP BY word ORDER BY word
"""

CONTRACT_LONG = f"""
WITH RECURSIVE state(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM words
    UNION
    {_STEP.format(base=BASE, pairs="""
        SELECT word, tokens, pos, token || next_token AS pair
        FROM (
            SELECT word, tokens, unnest(cut) AS token, unnest(cut[2:]) AS next_token, unnest(range(1, len(cut) + 1)) AS pos
            FROM (SELECT word, tokens, string_split(tokens, '') AS cut FROM state)
        ) WHERE next_token IS NOT NULL""")}
)
SELECT word, tokens FROM state ORDER BY word
"""

DECODE = """
SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS piece
FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> bytes:
    """The rank file, read once by the driver (under 1 MB) and carried to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _parse(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes make a token, with its key."""
    pairs = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    if max(ranks.values(), default=0) + BASE >= 0xD800:
        raise ValueError("the vocabulary is too large for one character a token")
    opens_smaller = {side for a, b, rank in pairs for side in (a, b) if rank < side}
    lefts: dict[int, set[int]] = {}
    rights: dict[int, set[int]] = {}
    for a, b, rank in pairs:
        lefts.setdefault(rank, set()).add(a)
        rights.setdefault(rank, set()).add(b)
    alone = {rank for a, b, rank in pairs if lefts[rank] == {a} and rights[rank] == {b}}
    bulk = [rank not in opens_smaller and (rank in alone or not lefts[rank] & rights[rank]) for _, _, rank in pairs]
    return pa.table(
        {
            "pair": pa.array([chr(BASE + a) + chr(BASE + b) for a, b, _ in pairs], pa.string()),
            "key": pa.array([(rank << 32) + (not b) for (*_, rank), b in zip(pairs, bulk, strict=True)], pa.int64()),
        }
    )


def _blocks(items: list, most: int, size: Callable = len) -> Iterator[list]:
    """Neighbouring items, joined until a block has `most` in all."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size(item)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


class BytePairs:
    """Encoder and decoder of one vocabulary in one Python worker."""

    def __init__(self, ranks: bytes, pattern: str):
        import duckdb

        table = _parse(ranks)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._keep("merges", merge_table(table))
        vocabulary = {"id": pa.array(list(table.values()), pa.int32()), "piece": [t.decode("latin-1") for t in table]}
        self._keep("vocabulary", pa.table(vocabulary))
        self.byte = np.array([BASE + table[bytes([i])] for i in range(256)], "<u4")
        self.pieces = PieceIds(pattern, self.encode_words)

    def _keep(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _ask(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (a match of the pattern), as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        flat = self.byte[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        sizes = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(sizes).tolist()
        tokens = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if not (sizes > SHORT).any():
            return self._contract(CONTRACT_SHORT, tokens)
        out = [b""] * len(tokens)
        for sql, at in ((CONTRACT_SHORT, np.flatnonzero(sizes <= SHORT)), (CONTRACT_LONG, np.flatnonzero(sizes > SHORT))):
            for i, ids in zip(at.tolist(), self._contract(sql, [tokens[i] for i in at.tolist()]), strict=True):
                out[i] = ids
        return out

    def _contract(self, sql: str, tokens: list[str]) -> list[bytes]:
        return [ids for block in _blocks(tokens, BYTES_AT_ONCE) for ids in self._contract_block(sql, block)]

    def _contract_block(self, sql: str, tokens: list[str]) -> list[bytes]:
        rows = pa.table({"word": pa.array(range(len(tokens)), pa.int32()), "tokens": pa.array(tokens, pa.string())})
        final = self._ask(sql, "words", rows)["tokens"].to_pylist()
        # Four bytes a character: UTF-32 code units are the ids plus the offset.
        flat = np.frombuffer("".join(final).encode("utf-32-le"), "<u4") - np.uint32(BASE)
        raw, ends = flat.astype("<u4").tobytes(), np.cumsum([0] + [4 * len(t) for t in final])
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence."""
        # Decoding is by id, so a long sequence may be cut anywhere.
        step = 4 * IDS_AT_ONCE
        cut = [(k, x[at : at + step]) for k, x in enumerate(ids) for at in range(0, len(x), step)]
        out = [b""] * len(ids)
        for block in _blocks(cut, step, lambda c: len(c[1])):
            for (k, _), piece in zip(block, self._decode([x for _, x in block]), strict=True):
                out[k] += piece
        return out

    def _decode(self, ids: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(ids), "<i4")
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        rows = pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
        found = self._ask(DECODE, "ids", rows)
        out = [b""] * len(ids)
        for k, piece in zip(found["doc"].to_pylist(), found["piece"].to_pylist(), strict=True):
            out[k] = piece.encode("latin-1")
        return out


@lru_cache(maxsize=1)
def worker(ranks: bytes, pattern: str) -> BytePairs:
    """One encoder a Python worker, kept between its tasks."""
    return BytePairs(ranks, pattern)


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (binary).

    Null texts are empty: no ids and no bytes. Every whole text is encoded, without special tokens.
    Repeated rows give repeated results; a null id stays null; an empty table gives no rows. Only the
    two named columns are read.
    """
    return _run(docs, ranks, pattern, id_col, text_col, False)


def digest(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode_decode`, reduced where the ids lie: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _run(docs, ranks, pattern, id_col, text_col, True)


def _run(docs: DataFrame, ranks: bytes, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    lower_arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = worker(shared.value, pattern)
        for rows, texts in text_batches(batches, 1):
            ids = pairs.pieces.encode_texts(texts)
            decoded = pairs.decode(ids)
            if digests:
                hexed = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                columns = {
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": hexed(ids),
                    "decoded_sha256": hexed(decoded),
                }
            else:
                columns = {
                    "ids": pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())),
                    "decoded": pa.array(decoded, pa.binary()),
                }
            yield from pa.table({"doc_id": rows["doc_id"], **columns}).combine_chunks().to_batches()

    shape = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return source.mapInArrow(run, f"doc_id {kind}, {shape}")
