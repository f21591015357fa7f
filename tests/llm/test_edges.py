"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terraquant.llm import bpe, chat, components, exact, langid, licences, packing, pretokens, quality, rules, simhash, urls

LONG = " ".join(f"word{i % 977} and more," for i in range(40_000))
ROWS = [
    (1, "Plain words in a row, and a few more of them.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, LONG, "en", None),
    (5, "plain words in a row, and a few more of them.", "en", "b"),
    (5, "plain words in a row, and a few more of them.", "en", "b"),
    (None, "Ein Satz ohne Nummer", "de", "a"),
    (7, " \t\n\x0b ", "de", "a"),
    (8, "É ß 漢字 🙂 <|endoftext|>", "de", "c"),
    (9, "x" * 3000, "de", "c"),
]
CLASHES = ["host", "kept", "digest", "fp", "score", "words", "text_hash", "word", "h", "ids", "hash", "heavy", "root", "node"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("n_chars", F.char_length("text").cast("long")).repartition(3).cache()


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def _operators(ranks, definition):
    model = langid.fit_words({"en": Counter(word=3, plain=1), "de": Counter(satz=2, ein=1)})
    none = quality.fit_counts(np.zeros((0, quality.TERMS), np.float32), np.zeros(0))
    return {
        "bpe": lambda d: bpe.encode_decode(d, ranks, public_tokenizers.PATTERN),
        "rules": rules.judge,
        "langid": lambda d: langid.predict(d, model),
        "exact": exact.flag_copies,
        "simhash": simhash.near_components,
        "quality": lambda d: quality.score(d, none),
    }


@pytest.mark.parametrize("name", ["bpe", "rules", "langid", "exact", "simhash", "quality"])
def test_one_row_per_document_and_none_for_an_empty_table(docs, ranks, definition, name):
    operator = _operators(ranks, definition)[name]
    got = operator(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert operator(docs.limit(0)).count() == 0


def test_bpe_round_trip_and_ids(docs, ranks):
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._parse(ranks), special_tokens={})
    texts = sorted((str(r[0]), r[1] or "") for r in ROWS)
    got = sorted(((str(r["doc_id"]), bytes(r["decoded"]).decode(), r["ids"]) for r in bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN).collect()), key=str)
    assert sorted((i, t) for i, t, _ in got) == texts
    assert all(ids == known.encode_ordinary(t) for _, t, ids in got)


def test_bpe_fuzz_and_long_words(ranks):
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._parse(ranks), special_tokens={})
    rng = random.Random(7)
    alphabet = "aabbc  \n\t.,'’éß漢🙂\x1c\x00\x851²Ⅷ'st'll<|>!"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)]
    texts += ["a" * 4000, "ab" * 2000, " " * 700, "é" * 900 + "\n" * 30, "\n \n  x", "a  ", "a   b   "]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(800))]
    pairs = bpe.BytePairs(ranks, public_tokenizers.PATTERN)
    ids = pairs.pieces.encode_texts(texts)
    assert all(np.frombuffer(x, "<u4").tolist() == known.encode_ordinary(t) for x, t in zip(ids, texts, strict=True))
    assert pairs.decode(ids) == [t.encode() for t in texts]


def test_decoding_cuts_long_sequences(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 7)
    pairs = bpe.BytePairs(ranks, public_tokenizers.PATTERN)
    texts = ["a long enough text to be cut in many places", "", "short"]
    assert pairs.decode(pairs.pieces.encode_texts(texts)) == [t.encode() for t in texts]


def test_cache_bound_does_not_change_results(ranks, monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 3)
    pairs = bpe.BytePairs(ranks, public_tokenizers.PATTERN)
    texts = ["one two three four", "five six seven", "one two eight"]
    assert [pairs.decode(pairs.pieces.encode_texts([t]))[0].decode() for t in texts] == texts


def test_rules(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in rules.judge(docs).collect()}
    assert got[2, 0]["base_failed"] and not got[2, 0]["kept"]
    assert got[4, 120_000]["n_repeat_words"] == 120_000 and got[4, 120_000]["base_failed"]


def test_rules_remove_boilerplate_and_reject_depleted(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(i, f"{body(i)}\n{common.upper()}  \n{body(i + 1000)}", "h") for i in range(30)]
    rows += [(100 + i, f"{common}\n{common}\nonly {i} of these words are mine", "h") for i in range(5)]
    rows += [(200 + i, f"{common}\n{body(i)}", "other") for i in range(5)]
    rows += [(300 + i, f"{body(999)}\n{body(998)}", "h") for i in range(40)]  # exact copies are no boilerplate
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rules.judge(df).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 40 for i in range(30))
    assert not any(got[100 + i]["kept"] for i in range(5))
    assert all(got[200 + i]["kept"] and got[200 + i]["removed_words"] == 0 for i in range(5))
    assert all(got[300 + i]["kept"] for i in range(40))
    texts = {r["doc_id"]: r["text"] for r in rules.apply_rules(df).collect()}
    assert texts[3] == f"{body(3)}\n{body(1003)}" and texts[200] == rows[35][1]
    assert set(texts) == {i for i, r in got.items() if r["kept"]}


def test_langid_backoff():
    model = langid.fit_words({"en": Counter(the=50, thing=5), "de": Counter(der=50, dinge=5)})
    assert model.predict("the")[0] == "en" and model.predict("der der")[0] == "de"
    assert model.predict("thingy")[0] == "en" and model.predict("dingen")[0] == "de"
    assert model.predict(None) == model.predict("12 ²Ⅷ !") == model.predict("") == ("und", 0.0)
    assert model.predict("漢")[0] in ("en", "de")
    assert langid.fit_words({}).predict("text") == ("und", 0.0)


def test_exact_ties_nulls_and_repeats(docs):
    got = exact.flag_copies(docs).collect()
    same = [r for r in got if r["doc_id"] in (1, 5)]
    assert {r["keep_id"] for r in same} == {5} and {r["group_size"] for r in same} == {3}
    empty = {r["doc_id"]: r for r in got if r["doc_id"] in (2, 3)}
    assert empty[3]["kept"] and not empty[2]["kept"]
    assert empty[2]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "7", "8", "9", "None"]


@pytest.mark.parametrize("heavy", [1, 3])
def test_exact_copies_do_not_depend_on_the_heavy_split(spark, heavy):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 700) END AS text")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.flag_copies(df, tracked=16, heavy=heavy).collect()}
    groups: dict[str, list[int]] = {}
    for i in range(3000):
        groups.setdefault("hot" if i % 3 == 0 else f"t{i % 700}", []).append(i)
    assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_simhash_nulls_and_hot_groups(spark, docs):
    got = simhash.near_components(docs).collect()
    zero = [r for r in got if r["doc_id"] in (2, 3, 7)]
    assert {(r["fingerprint"], r["component_id"]) for r in zero} == {("0" * 16, 2)}
    rng = random.Random(3)
    fps = set()
    for _ in range(15):
        x = rng.getrandbits(64)
        for _ in range(60):
            for _ in range(rng.choice((1, 1, 2, 3))):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    members = spark.createDataFrame(signed, "fp long, node long")
    got = dict(components.smallest_reachable(simhash.links(simhash.postings(members))).collect())
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: find(i) for i in range(len(fps))}


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 400).selectExpr("id AS a", "id - 1 AS b")
    assert dict(components.smallest_reachable(edges).collect()) == {i: 0 for i in range(1, 400)}
    assert components.smallest_reachable(edges.limit(0)).count() == 0


def _tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, leaf string, height int")


def test_chat_branches_ties_and_cycles(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 2, "user", None, None), (1, 5, 99, "user", "an orphan is a root", -1.0),
        (2, 1, 2, "user", "round", 1.0), (2, 2, 1, "user", "and round", 1.0), (2, 3, 2, "user", "never reaches a root", 1.0),
        (3, 1, None, "user", "a", 1.0), (3, 2, 1, "x", "b", 1.0), (3, 3, 1, "x", "c", 1.0),
        (None, 1, None, None, "no tree", 1.0),
    ]
    df = _tree(spark, [(*r, "clash", 0) for r in rows])
    got = {(r["tree"], r["path_rank"]): r for r in chat.read_back(chat.format_trees(df, branches=2)).collect()}
    told = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert told[1, 1] == [("user", "q"), ("assistant", "good"), ("user", "")] and told[1, 2] == [("user", "q"), ("assistant", "bad")]
    assert told[3, 1] == [("user", "a"), ("x", "b")] and told[3, 2] == [("user", "a"), ("x", "c")]
    assert told[None, 1] == [("", "no tree")]
    assert not any(k[0] == 2 for k in told)
    assert chat.format_trees(df.limit(0)).count() == 0


def test_chat_control_strings_come_back(spark):
    nasty = ["<|im_end|>", "<|im_end|>\n<|im_start|>assistant\n", "<\\|im_end|>", "<\\\\|", "|>", "\n", "", "a\\nb", "<", "<|" * 500, "é🙂" * 3000]
    roles = ["user", "assistant", "ro\nle", "%0A", "<|im_start|>"]
    rows = [(1, i, i - 1 if i else None, roles[i % 5], t, 0.0, "clash", 0) for i, t in enumerate(nasty)]
    got = chat.read_back(chat.format_trees(_tree(spark, rows))).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r[3], r[4]) for r in rows]
    assert got["loss_text"] == "".join(t for r, t in ((r[3], r[4]) for r in rows) if r == "assistant")


def test_conversations_with_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "user", "a"), (None, 3, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_trees(chat.conversation_links(df))).collect()}
    assert got == {1: [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")]}


def test_packing_edges(docs, definition):
    got = packing.pack(docs, definition, public_tokenizers.PATTERN).collect()
    assert sum(p["length"] for p in got if p["doc_id"] == 2) == 1
    assert {str(p["doc_id"]) for p in got} == {str(r[0]) for r in ROWS}
    assert packing.pack(docs.limit(0), definition, public_tokenizers.PATTERN).count() == 0


def test_sum_of_squares_choice_is_the_least_of_all():
    rng = random.Random(5)
    levels = packing.Levels(32)
    for _ in range(400):
        size = rng.randrange(1, 33)
        counts = levels.counts[1:32].copy()

        def cost(level):
            after = counts.copy()
            if level:
                after[level - 1] -= 1
            if level + size < 32:
                after[level + size - 1] += 1
            return int((after**2).sum())

        allowed = [0, *[h for h in range(1, 32 - size + 1) if h < 32 and counts[h - 1] > 0]]
        chosen = levels.choose(size)
        assert chosen in allowed and cost(chosen) == min(map(cost, allowed))
        levels.place((0, 0, b"\0" * 4 * size), size)


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme/porn"), (4, "http://A.Example.ORG/es/x"), (5, "https://example.org/en/12?q#f"), (6, "http://x.org/y"),
        (7, "ftp://shop.com/fr/1"), (8, "http://shop.com/de/"), (9, "http://x.net/porn"), (10, "http://x.net/pornography"),
        (11, "http://x.net/free"), (12, "http://free-bets.net/"), (13, "http://free.net/free?free"), (14, "http://org"), (14, "http://org"), (None, "http://x.net/" + "a" * 100_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "verdict")})
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()]
    told = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert told[1] == told[2] == ("", None, "allow") and told[3] == ("", None, "block")
    assert told[4] == ("a.example.org", "example.org/es/", "block") and told[5] == ("example.org", "example.org/en/1", "block")
    assert told[6] == ("x.org", "org/", "allow") and told[7] == ("shop.com", "com/fr/", "allow") and told[8][1:] == ("com/de/", "block")
    assert told[9][2] == "block" and told[10][2] == told[11][2] == told[13][2] == "allow" and told[12][2] == "block"
    assert told[14] == ("org", None, "allow") and told[None][2] == "allow"
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_licences(spark, docs):
    texts = [None, "", "The license plate is gone", "x\nLicensed under CC BY-SA 4.0\ny", "Released under the MIT License.", "All rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("paragraph", F.lit("clash")).withColumn("p", F.lit(1))
    model = licences.fit(docs.unionByName(df, allowMissingColumns=True))
    got = {r["doc_id"]: (r["number"], r["family"], r["confirmed"]) for r in licences.scan(df, model).collect()}
    assert got == {2: (0, "unknown", False), 3: (1, "cc-by-sa", True), 4: (0, "mit", True), 5: (0, "proprietary", True)}
    assert {r["doc_id"]: r["licences"] for r in licences.document_licences(df, model).collect()} == {3: "cc-by-sa", 4: "mit", 5: "proprietary"}
    assert licences.scan(df.limit(0), model).count() == 0


def test_licence_paragraphs(spark, docs):
    """Every paragraph with a term of the vocabulary is scored, with or without a licence word; hard-wrapped notices are read whole."""
    import textwrap

    from test_licences_plain import probabilities

    rows = [("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not given, see below."),
            ("bsd", "A title\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. the first"),
            ("agpl", "it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation"),
            ("plain", "One line without it.\r\n\r\n  \nAnother one\n\nxyzzy")]
    for w in (50, 60, 72, 80):
        rows += [(f"{w} {i}", "Title\n\n" + textwrap.fill(n, w) + "\n\nAnd then another paragraph.") for i, (_, n) in enumerate(licences.NOTICES)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    model = licences.fit(docs)
    told = licences.scan(df, model).collect()
    found = {(r["doc_id"], r["number"]): r["family"] for r in told if r["confirmed"]}
    assert found["mpl", 0] == "mpl-2.0" and found["bsd", 2] == "bsd" and found["agpl", 0] == "agpl"
    assert [(r["number"], r["paragraph"]) for r in told if r["doc_id"] == "plain"] == [(0, "One line without it."), (3, "Another one")]
    assert all(found[f"{w} {i}", 2] == f for w in (50, 60, 72, 80) for i, (f, _) in enumerate(licences.NOTICES))
    plain = probabilities(model, [r["paragraph"] for r in told])
    assert max(abs(r["probability"] - p) for r, p in zip(told, plain, strict=True)) < 1e-9


def test_licence_sample_counts_a_paragraph_once(spark):
    """However often a paragraph occurs, the sample holds it once and stays near its bound."""
    lines = [f"line number {i} of many" for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "paragraph string")
    rows = licences.training_rows(spark, df.unionByName(df).unionByName(df), 300).where("family = 'unknown' and text like 'line number%many'")
    held = [r["text"] for r in rows.collect()]
    assert len(held) == len(set(held)) and 150 < len(held) < 500


def test_quality_without_labels_and_with_conflicts(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (5, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.keep_good(docs, quality.fit(docs, labels.limit(0), F.lit(True))).count() == len(ROWS)


def test_stage_operators_keep_columns_with_their_own_names(spark):
    """Columns named like those that the operators add come back untouched."""
    from terraquant.llm import jaccard

    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body, "a"), (2, body.upper(), "a"), (3, body + " end", "a"), (None, body, None), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["own_id", "OWN_HOST", "own_hash", "own_kept", "own_removed", "own_digest", "its_own_id", "own_doc_id", "kept_id", "v_id", "dropped_id", "removed"]
    for name in names:
        df = df.withColumn(name, F.lit(name))
    ids = {}
    for fn in (rules.apply_rules, exact.drop_copies, jaccard.drop_near_copies):
        out = fn(df)
        assert out.columns == df.columns
        got = out.collect()
        assert all(r[n] == n for r in got for n in names)
        ids[fn.__name__] = sorted(str(r["doc_id"]) for r in got)
    assert ids == {"apply_rules": ["1", "2", "3", "None"], "drop_copies": ["2", "3", "None"], "drop_near_copies": ["1", "None"]}


def test_packing_knows_added_tokens(definition):
    from tokenizers import Tokenizer

    own = packing.FileEncoder(definition, public_tokenizers.PATTERN)
    known = Tokenizer.from_str(definition.decode())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x \n", " <|endoftext", "é <|endoftext|>, 漢字!? don't", "x" * 5000 + "<|endoftext|> ,;"):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == known.encode(text, add_special_tokens=False).ids
        assert ("<|endoftext|>" in text) == (50256 in ids)


def test_packing_tokenizes_each_match_of_a_batch_once(definition, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KEYS", 0)
    own = packing.FileEncoder(definition, public_tokenizers.PATTERN)
    seen, tokenize = [], own.tokenize
    own.tokenize = lambda mapped: seen.append(mapped) or tokenize(mapped)
    texts = [f"Wörter wort{' wort' * (i % 3)}, wort.\nWort; {' '.join(f'w{k} {k}' for k in range(50))}" for i in range(40)]
    known = Tokenizer.from_str(definition.decode())
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_texts(texts)]
    assert got == [known.encode(t, add_special_tokens=False).ids for t in texts]
    # Pieces that only the pattern can cut share no more than their matches with the others.
    assert max(seen.count(m) for m in seen) <= 2 and len(seen) < 300


@pytest.mark.parametrize("keys", [0, 5, 400_000])
def test_packing_batches_agree_with_the_library(definition, monkeypatch, keys):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KEYS", keys)
    rng = random.Random(11)
    alphabet = "abé  \n\t.,'’ß漢🙂\x1c\x00\x85\xa0\u2003\u3000\u200b01²Ⅷ'st'll<|>!$ªµ×٣\xad"
    texts = ["", " ", "  ", "\n \n", "a ", "x<|endoftext|> y", "<|endoftext|>", "a.\nB\nc", "é'll 'll", "a\x85 \x85b"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += [" ".join("".join(rng.choice("abé1.,\n'$") for _ in range(rng.randrange(1, 9))) for _ in range(20)) for _ in range(200)]
    own, known = packing.FileEncoder(definition, public_tokenizers.PATTERN), Tokenizer.from_str(definition.decode())
    expected = [known.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 7, len(texts)):
        got = [x for i in range(0, len(texts), size) for x in own.encode_texts(texts[i : i + size])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == expected


def test_packing_by_another_pattern(definition):
    pattern = r"\p{L}+| ?[^\s\p{L}]+[\r\n]*|\s+"
    own = packing.FileEncoder(definition, pattern)
    text = "one two.\nThree 12345, four."
    matches = own.by_match.findall(text)
    assert own.encode(text) == b"".join([own._tokenized([m]).ids.tobytes() for m in matches])


def test_messages_without_a_node_keep_their_text(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, None, 1, "assistant", "lost?", 5.0), (1, None, 1, "assistant", "no", 4.0),
        (2, None, None, "user", "alone", 0.0), (2, None, None, "user", "alone", 0.0),
    ]
    expected = {1: [["q", "lost?"], ["q", "no"]], 2: [["alone"], ["alone"]]}
    numbered = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    named = numbered.withColumns({c: F.col(c).cast("string") for c in ("node", "parent")})
    for df in (numbered, named):
        got = {}
        for r in chat.read_back(chat.format_trees(df, branches=3)).orderBy("tree", "path_rank").collect():
            got.setdefault(r["tree"], []).append([t["text"] for t in r["turns"]])
        assert got == expected


def test_random_reply_trees_rank_branches_by_score(spark):
    """All root-to-leaf paths of random trees, ranked by mean score, by plain recursion."""
    rng = random.Random(8)
    rows = [
        (t, n, rng.randrange(n) if n and rng.random() < 0.9 else None, rng.choice(["user", "assistant"]), f"t{t} n{n}", rng.randrange(5) / 2)
        for t in range(12) for n in range(rng.randrange(1, 15))
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").repartition(3)
    expected = {}
    for t in range(12):
        own = {n: (p, text, s) for x, n, p, _, text, s in rows if x == t}
        paths = []
        for leaf in set(own) - {p for p, _, _ in own.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = own[at][0]
            paths.append((-sum(own[n][2] for n in path) / len(path), leaf, [own[n][1] for n in reversed(path)]))
        for rank, (_, _, texts) in enumerate(sorted(paths)[:3], 1):
            expected[t, rank] = texts
    got = {(r["tree"], r["path_rank"]): [x["text"] for x in r["turns"]] for r in chat.read_back(chat.format_trees(df, branches=3)).collect()}
    assert got == expected


def test_quality_sample_counts_a_repeated_id_once(spark):
    rows = [(i % 7, f"text {i} with words") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(0, 70, 7)] + [(i, i % 2) for i in range(7)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    assert len(model.labels) <= 9
