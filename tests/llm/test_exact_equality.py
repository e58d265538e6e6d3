"""Texts whose rolling hashes collide, tables of empty texts alone, null ids and long texts, for all operators."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import bpe_automaton, media, near_dedup, packing, quality_rules, suffix_arrays, suffix_trees, templates, textkit, toxicity, training_order
from tidewell.llm.queries import vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
SWAPPED = str.maketrans("ab", "ba")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(SWAPPED)
    return s


ONE = thue_morse(2048)
TWO = ONE.translate(SWAPPED)


def frame(spark, texts, parts=1):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(parts)


def test_the_hash_does_collide():
    data, offs = textkit.text_bytes(pa.array([ONE, TWO]))
    words = textkit.Words(data, offs)
    assert words.hash[0] == words.hash[1] and words.number[0][0] != words.number[0][1]
    assert words.digests()[0][0] != words.digests()[0][1]


def test_numbered_against_a_dictionary():
    r = random.Random(2)
    pieces = [r.choice([ONE, TWO, ONE + "c", TWO + "c", "", "x", "yy"]) for _ in range(200)]
    data, offs = textkit.text_bytes(pa.array(pieces))
    number, at = textkit.numbered(data, offs[:-1], offs[1:])
    assert len(set(number.tolist())) == len(set(pieces)) == len(at)
    assert all((number[i] == number[j]) == (pieces[i] == pieces[j]) for i in range(200) for j in range(200))
    assert all(pieces[at[n]] == p for n, p in zip(number.tolist(), pieces, strict=True))
    values = np.array([r.randint(0, 2) for _ in range(300)])
    for n in (1, 2, 3, 5, 8, 20):
        got = textkit.window_numbers(values, n)
        runs = [tuple(values[k : k + n]) for k in range(300 - n + 1)]
        assert len(got) == len(runs) and len(set(got.tolist())) == len(set(runs)) == len(set(zip(got.tolist(), runs, strict=True)))


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    for r in bpe_automaton.coded(frame(spark, {1: ONE, 2: TWO}), WORD).collect():
        ids = t.encode({1: ONE, 2: TWO}[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_packing_and_training_order(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    texts = {1: ONE, 2: TWO}
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    for p in packing.packed(frame(spark, texts), BYTE).collect():
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    rows = training_order.sequences(training_order.written(frame(spark, texts), BYTE, length=64), 64).collect()
    flat = np.concatenate([np.frombuffer(r.ids, "<u4")[: r.n_tokens] for r in sorted(rows, key=lambda r: r.sequence)])
    assert flat.tolist() == np.concatenate([ids[1], ids[2]]).tolist()


def test_suffix_trees(spark):
    some = " ".join(f"w{k}" for k in range(19))
    got = {r.doc_id: r.n_removed for r in suffix_trees.digests(frame(spark, {1: f"{some} {ONE}", 2: f"{some} {TWO}", 3: f"{some} {TWO}"})).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_suffix_arrays(spark):
    got = {r.doc_id: r.n_removed for r in suffix_arrays.digests(frame(spark, {1: ONE, 2: ONE[:99], 3: ONE[1:100] + "c", 4: "c" + ONE[1:101]})).collect()}
    seen = {ONE[k : k + 100] for k in range(len(ONE) - 99)}
    assert got[2] == 0 and got[3] == 0 and got[4] == (100 if ONE[1:101] in seen else 0)


def test_near_dedup(spark):
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(frame(spark, {1: ONE, 2: TWO, 3: ONE}), 4, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_quality_rules(spark):
    row = quality_rules.ledger(frame(spark, {1: f"{ONE}\n{TWO}\n{ONE}"})).first()
    assert (row.n_words, row.n_dup_lines) == (3, 1)


LABELS = [(1, 1, 0), (2, 1, 1)]
OPERATORS = {
    "bpe": lambda spark, docs: bpe_automaton.coded(docs, WORD),
    "trees": lambda spark, docs: suffix_trees.digests(docs),
    "order": lambda spark, docs: training_order.sequences(training_order.written(docs, BYTE)),
    "toxicity": lambda spark, docs: toxicity.scored(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")),
    "media": lambda spark, docs: media.stored(docs),
    "arrays": lambda spark, docs: suffix_arrays.digests(docs),
    "packing": lambda spark, docs: packing.packed(docs, BYTE),
    "near": lambda spark, docs: near_dedup.near_groups(docs, 4, 80),
    "rules": lambda spark, docs: quality_rules.ledger(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_tables_of_empty_texts_alone(spark, name):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, None), (None, "")], "doc_id long, text string").coalesce(1)
    rows = OPERATORS[name](spark, docs).collect()
    assert len(rows) == 1 if name == "order" else sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "None"]
    if name == "rules":
        assert all(r.failed == quality_rules.BITS["few_words"] and r.n_dup_lines == r.word_chars == 0 for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_and_texts_of_several_blocks(spark, name):
    r = random.Random(4)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200_000))
    docs = spark.createDataFrame([(None, "one two three"), (None, "one two three"), (7, long), (8, "short text")], "doc_id long, text string").coalesce(1)
    rows = OPERATORS[name](spark, docs).collect()
    if name == "order":
        assert {i for r in rows for i in r.doc_ids} == {None, 7, 8} and sum(r.n_tokens for r in rows) > 200_000
    elif name == "packing":
        assert {r.doc_id for r in rows} == {None, 7, 8} and sum(r.length for r in rows if r.doc_id == 7) == next(r.doc_tokens for r in rows if r.doc_id == 7)
    else:
        assert sorted(str(r.doc_id) for r in rows) == ["7", "8", "None", "None"]


def test_pages_without_ids(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.example/", ""), (1, "http://a.example/", "<p>x")], "page_id long, url string, html string")
    assert sorted(str(r.page_id) for r in templates.extracted(pages).collect()) == ["1", "1", "None"]


def test_long_runs_of_white_space():
    from tidewell.llm import token_ids

    encoder = token_ids.text_encoder(BYTE)
    assert len(encoder.encode(" " * 300_000 + "a")) == len(encoder.whole(" " * 300_000 + "a"))


def test_subtrees_against_brute_force():
    r = random.Random(9)
    words = np.array([r.randint(0, 2) for _ in range(400)])
    starts = np.arange(400 - 20)
    trees = suffix_trees.subtrees(words, starts)
    runs = [tuple(words[s : s + 20].tolist()) for s in starts]
    # An internal node is a run of words that goes on in several ways.
    inner = {run[:d] for d in range(20) for run in runs if len({x[d] for x in runs if x[:d] == run[:d]}) > 1}
    assert sorted(trees.depth.tolist()) == sorted(map(len, inner))
    assert all(p < 0 or trees.depth[p] < d for p, d in zip(trees.parent.tolist(), trees.depth.tolist(), strict=True))
    again = {k for k in range(len(runs)) if runs.count(runs[k]) > 1}
    assert set(trees.deep.tolist()) == again and all((runs[a] == runs[b]) == (x == y) for a, x in zip(trees.deep, trees.group, strict=True) for b, y in zip(trees.deep, trees.group, strict=True))


def test_a_loss_limit_that_nothing_fits():
    with pytest.raises(ValueError):
        list(packing.pack(np.array([5]), lambda item, at, length: 9 * length, (8, 2, 4)))


def test_short_texts_leave_little_room(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["one", "two", "three"]) for _ in range(r.randint(1, 6)))) for i in range(9000)], "doc_id long, text string").coalesce(2)
    rows = packing.packed(docs, BYTE).collect()
    total = {}
    for p in rows:
        total[p.sequence_id] = total.get(p.sequence_id, 0) + p.length
    assert sum(x < 1020 for x in total.values()) <= -(-9000 // packing.LOT) + 2
