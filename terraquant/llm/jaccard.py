"""Similarity join of word n-gram sets: rare-first prefix filtering, exact, for components of links.

Two sets with Jaccard similarity of at least s / t share a token among the first n - ceil(s n / t) + 1
tokens of each, in any order common to all sets. The order here is rare first, by a table of counters
of fixed size over hashed tokens; its errors cost time, never links. Prefix tokens are joined, and a
pair has to pass the length filter, the positional filter (tokens left after the shared one) and the
suffix filter (sizes of the parts that fixed pivots cut both sets into) before its whole sets are read,
once. Equal sets are one node.

Only components are wanted, so a list of sets that share a token is not paired all with all. Every
list is first compared with one center, the member with the fewest rarer tokens (of near copies the
least changed one); pairs that this connects need no further comparison.
What remains are pairs of one list in different components, and these are joined under the filters.

Where near copies are dropped, every set also has a SimHash fingerprint. Pairs within few bits, found
by the index of operator 5, are verified with the pairs of the centers; the join then adds the links
that fingerprints do not show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch
from . import simhash
from .components import smallest_reachable
from .shared import filter_bits, filter_table, in_filter, keep_rows, lower_arrow_batches, split_by_filter

NGRAM = 4
# Least similarity as a fraction of whole numbers.
SIMILAR = (85, 100)
# Counters of the frequency table; 16 bits a task and counter, one byte each once merged.
COUNTERS = 1 << 20
CHUNK = 1 << 16
# Words a worker remembers the hashes of; a memory bound, results do not depend on it.
REMEMBERED = 200_000
# Parts that fixed pivots (the leading bits of a token's hash) cut a set into.
PARTS = 32
NONE = np.zeros(0, np.uint64)


class _Hashes(dict):
    """64-bit hash of a word, remembered; forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes of consecutive words, different for different orders and lengths."""
    out = np.full(len(columns[0]), 0x9E3779B97F4A7C15 * len(columns) & (1 << 64) - 1, np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def token_sets(texts: list[str | None], ngram: int, known: _Hashes) -> list[np.ndarray]:
    """Sorted different hashes of the word n-grams of each text.

    A-Z are lower-cased; words are what blanks and control line ends separate. Fewer words than
    `ngram` make one n-gram; a text without words has none.
    """
    # Lower-casing and splitting bytes knows A-Z and the six ASCII separators only.
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    hashed = np.array([known[w] for own in words for w in own], np.uint64)
    out, at = [], 0
    for own in words:
        h = hashed[at : at + len(own)]
        at += len(own)
        k = min(ngram, len(h))
        out.append(np.unique(_mixed([h[i : len(h) - k + 1 + i] for i in range(k)])) if k else NONE)
    return out


def _key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def _set_rows(docs: DataFrame, id_col: str, text_col: str, ngram: int, fingerprints: bool) -> DataFrame:
    """Per row: id, t1 and t2 (hashes of its text), n, k1 and k2 (name of its set), parts, fp; then, per task, its token counters.

    `fp` is the SimHash of the set, or null if not asked for. Rows of counters have a chunk number and nothing else but `counts`.
    """
    lower_arrow_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), *text_identity(text), text.alias("text"))
    schema = pa.schema(
        [("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
         ("parts", pa.list_(pa.int32())), ("fp", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Hashes(), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            sets = token_sets(batch.column(3).to_pylist(), ngram, known)
            if not sets:
                continue
            counts += np.bincount(np.concatenate(sets) >> np.uint64(44), minlength=COUNTERS).astype(np.uint32)
            keys = np.array([_key(s) for s in sets], np.int64)
            parts = np.concatenate([np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=PARTS) for s in sets])
            size, none = len(sets), pa.nulls(len(sets))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * PARTS, pa.int32()), pa.array(parts, pa.int32()))
            fps = pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)) if fingerprints else none.cast(pa.int64())
            columns = [*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists, fps]
            yield pa.RecordBatch.from_arrays([*columns, none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        chunks = np.minimum(counts, 0xFFFF).astype("<u2").reshape(-1, CHUNK)
        held = [i for i, c in enumerate(chunks) if c.any()]
        rows = [{"chunk": i, "counts": chunks[i].tobytes()} for i in held]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return source.mapInArrow(
        run, "id long, t1 long, t2 long, n long, k1 long, k2 long, parts array<int>, fp long, chunk int, counts binary"
    )


def text_identity(text: Column) -> list[Column]:
    """Two 64-bit hashes (t1, t2) that tell the texts of one id apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _frequency_classes(rows: DataFrame) -> np.ndarray:
    """A byte per counter: a quarter of an octave of the token's frequency. `COUNTERS` bytes, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), "<u2").astype(np.int64)
                total[chunk] = total[chunk] + own if chunk in total else own
        classes = [np.minimum(4 * np.log2(1 + t), 255).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(classes, pa.binary())], ["chunk", "classes"])

    parts = rows.where("chunk is not null").select("chunk", "counts").repartition(COUNTERS // CHUNK, "chunk")
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint8)
    for r in parts.mapInArrow(add, "chunk int, classes binary").collect():
        out[r["chunk"]] = np.frombuffer(bytes(r["classes"]), np.uint8)
    return out.reshape(-1)


def prefix_length(n, similar: tuple[int, int]):
    """How many of n tokens a set must show: two similar sets cannot both keep all they share beyond that."""
    return n - -(-n * similar[0] // similar[1]) + 1


def _postings(docs: DataFrame, text_col: str, ngram: int, similar: tuple[int, int], classes: np.ndarray, collided: list[int]) -> DataFrame:
    """(token, node, n, at): the prefix tokens of every different set of a task, with their place in the rare-first order."""
    shared = docs.sparkSession.sparkContext.broadcast((classes, frozenset(collided)))
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Hashes(), set()
        classes, collided = shared.value
        for batch in batches:
            tokens, nodes, sizes = [], [], []
            for s in token_sets(batch.column(0).to_pylist(), ngram, known):
                k1, k2 = _key(s)
                if not len(s) or (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                order = np.argsort(classes[s >> np.uint64(44)], kind="stable")
                tokens.append(s[order[: prefix_length(len(s), similar)]])
                nodes.append(k2 if k1 in collided else k1)
                sizes.append(len(s))
            if tokens:
                counts = [len(t) for t in tokens]
                at = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
                columns = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(nodes, np.int64), counts), np.repeat(sizes, counts), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "token long, node long, n long, at int")


def _set_table(rows: DataFrame, ngram: int, bits: np.ndarray) -> DataFrame:
    """(k1, k2, tokens) of the sets of a task whose text may be wanted, each once."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Hashes(), set()
        for batch in batches:
            texts = batch.column(0).filter(pa.array(in_filter(shared.value, batch.column(1).to_numpy())))
            own = {k: s for s in token_sets(texts.to_pylist(), ngram, known) if (k := _key(s)) not in seen}
            seen.update(own)
            keys = np.array(list(own), np.int64).reshape(-1, 2)
            offsets = pa.array(np.cumsum([0, *map(len, own.values())]), pa.int32())
            tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([NONE, *own.values()]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), tokens], ["k1", "k2", "tokens"])

    return rows.select("text", "t1").mapInArrow(run, "k1 long, k2 long, tokens array<long>")


def _among(df: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose `name` may be among the keys, found where they lie; a join settles the false hits."""
    table = materialise(filter_table(keys.select(F.xxhash64(name))), "jaccard-filter")
    return split_by_filter(df, F.xxhash64(name), table)[1]


def _admissible(similar: tuple[int, int]) -> Column:
    """Length and positional filters of two members (n, at) and (m, by) of one list."""
    s, t = similar
    # The shared token and what follows it, where it is the first they share.
    left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("by"))
    return (s * F.greatest("n", "m") <= t * F.least("n", "m")) & ((s + t) * left >= s * (F.col("n") + F.col("m")))


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, ngram: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar: the suffix filter on narrow rows, then one look at both whole sets."""
    s, t = similar
    pairs = materialise(pairs, "jaccard-candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    told = _among(nodes.drop("fp"), "node", ends)
    a, b = (told.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"p{x}")) for x in "ab")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    # Similar sets differ in at most n + m - 2 s / (s + t) (n + m) tokens.
    near = (s + t) * apart <= (t - s) * (F.col("na") + F.col("nb"))
    pairs = materialise(pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "na", "nb"), "jaccard-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(told.drop("parts").join(ends, "node", "left_semi"), "jaccard-wanted")
    text = F.col(text_col).cast("string")
    rows = docs.select(text_identity(text)[0], text.alias("text"))
    # Only the sets of wanted texts leave their tasks; copies of a text give the same set, so any will do.
    found = _set_table(rows, ngram, filter_bits(wanted.select("t1"))).join(wanted.select("k1", "k2", "node"), ["k1", "k2"])
    sets = found.groupBy("k1", "k2").agg(F.first("node").alias("node"), F.first("tokens").alias("tokens"))
    sets = materialise(sets.select("node", "tokens"), "jaccard-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    kept = pairs.join(left, "a").join(right, "b").where(both * (s + t) >= s * (F.col("na") + F.col("nb")))
    return materialise(kept.select("a", "b"), "jaccard-links", keep=True)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, ngram: int, similar: tuple[int, int]) -> DataFrame:
    """As `_verify`; the sets and what led to them are deleted once the links are written."""
    with scratch(docs.sparkSession):
        return _verify(pairs, nodes, docs, text_col, ngram, similar)


def _nodes(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """One row per different set: node, k1, k2, n, parts, fp, and a text hash of one of its rows; and the k1 that two sets share."""
    first = F.min("t1").alias("t1")
    sets = rows.where("n > 0").groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max("parts").alias("parts"), F.max("fp").alias("fp"), first)
    sets = materialise(sets, "jaccard-node-sets")
    # Two unlike sets with equal k1: expected not once in 10^9 sets. Their nodes are named by k2.
    collided = [r["k1"] for r in sets.groupBy("k1").count().where("count > 1").collect()]
    node = F.when(F.col("k1").isin(collided), F.col("k2")).otherwise(F.col("k1")) if collided else F.col("k1")
    return sets.select(node.alias("node"), "k1", "k2", "n", "parts", "fp", "t1"), collided


def _center_order() -> Column:
    """Orders the members of a list: fewest rarer tokens first, as in the text that near copies were made from."""
    return F.col("at").cast("long") * (1 << 40) + F.shiftrightunsigned("node", 24)


def _lists(postings: DataFrame) -> DataFrame:
    """Members (token, node, n, at, is_center) of the lists with two or more different sets."""
    told = postings.select("token", "node", _center_order().alias("o"))
    stats = told.groupBy("token").agg(F.min("o").alias("least"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    stats = materialise(stats.select("token", "least"), "jaccard-shared")
    members = _among(postings, "token", stats).join(stats, "token")
    return materialise(members.select("token", "node", "n", "at", (_center_order() == F.col("least")).alias("is_center")), "jaccard-lists", keep=True)


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked in the index of operator 5, as stars."""
    members = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "jaccard-fingerprints")
    linked = simhash.links(simhash.postings(members))
    equal = nodes.select("fp", F.col("node").alias("b")).join(members.select("fp", F.col("node").alias("a")), "fp").where("a <> b")
    return linked.unionByName(equal.select("a", "b"))


def links(
    docs: DataFrame, nodes: DataFrame, members: DataFrame, text_col: str, ngram: int, similar: tuple[int, int], fingerprints: bool = False
) -> DataFrame:
    """Verified links (a, b) that connect every pair of similar sets; `members` are the lists of shared tokens.

    With `fingerprints`, the pairs that the index of fingerprints proposes are verified first, with those of the centers.
    """
    centers = members.where("is_center").select("token", F.col("node").alias("a"), F.col("n").alias("m"), F.col("at").alias("by")).distinct()
    stars = members.where("not is_center").join(centers, "token").where(_admissible(similar))
    proposed = stars.select("a", F.col("node").alias("b"))
    if fingerprints:
        proposed = proposed.unionByName(_fingerprint_pairs(nodes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = _verified(proposed.distinct(), nodes, docs, text_col, ngram, similar)
    roots = materialise(smallest_reachable(first), "jaccard-roots")
    rest = members.where("not is_center").join(roots, "node", "left").select(
        "token", "node", "n", "at", F.coalesce("root", "node").alias("root")
    )
    open_lists = rest.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_lists = materialise(open_lists.select("token"), "jaccard-open-lists")
    rest = materialise(_among(rest, "token", open_lists).join(open_lists, "token").distinct(), "jaccard-rest")
    other = rest.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.col("at").alias("by"), F.col("root").alias("its_root"))
    pairs = rest.join(other, "token").where((F.col("root") < F.col("its_root")) & _admissible(similar))
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return first.unionByName(_verified(pairs, nodes, docs, text_col, ngram, similar))


def _placed(docs: DataFrame, id_col: str, text_col: str, ngram: int, similar: tuple[int, int], fingerprints: bool = False) -> DataFrame:
    """One row per input row: id, t1, t2, n, and its component (a node; null for texts without words)."""
    with scratch(docs.sparkSession):
        written = materialise(_set_rows(docs, id_col, text_col, ngram, fingerprints), "jaccard-rows")
        rows = written.where("chunk is null").drop("chunk", "counts")
        nodes, collided = _nodes(rows)
        with scratch(docs.sparkSession):
            postings = _postings(docs, text_col, ngram, similar, _frequency_classes(written), collided)
            members = _lists(materialise(postings, "jaccard-postings"))
        roots = smallest_reachable(links(docs, nodes, members, text_col, ngram, similar, fingerprints))
        component = nodes.join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("component"))
        return materialise(rows.drop("parts", "fp").join(component, ["k1", "k2"], "left"), "jaccard-placed", keep=True)


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, similar: tuple[int, int] = SIMILAR
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null, empty and wordless texts have no n-gram, link with nothing and are their own component.
    Rows with equal sets are linked. An id repeated with another text has a row for each, with that
    text's component. A null id is never the smallest; a component of null ids only has a null
    component_id. An empty table gives no rows. Only the two named columns are read; ids are integers.
    """
    placed = _placed(docs, id_col, text_col, ngram, similar)
    least = materialise(placed.where("component is not null").groupBy("component").agg(F.min("id").alias("least")), "jaccard-least")
    return placed.join(least, "component", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similar: tuple[int, int] = (80, 100)
) -> DataFrame:
    """One row of each component of similar texts, the one with the smallest id, with its own columns.

    Links come from the SimHash index, each verified on whole sets, and from the join for what lies further apart.
    Texts without a word are one component. A null id counts as the largest, ties are broken by the
    hashes of the text, and a row that repeats id and text is returned once. An empty table gives no rows.
    """
    placed = _placed(docs, id_col, text_col, ngram, similar, fingerprints=True)
    order = [F.col("id").isNull(), F.col("id"), F.col("t1"), F.col("t2")]
    first = placed.groupBy("component").agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("first"))
    first = materialise(first, "jaccard-first")
    same = placed["component"].eqNullSafe(first["component"])
    kept = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]) == F.col("first")
    verdicts = placed.join(first, same).select("id", "t1", "t2", kept.alias("kept"))
    text = F.col(text_col).cast("string")
    return keep_rows(docs, [F.col(id_col).cast("long"), *text_identity(text)], verdicts)
