"""Certified packing, hard negatives and lexical search against brute force, with the awkward cases."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import certified_packing, hard_negatives, lexical_search
from tidewell.llm.queries import vocabulary

WORD = vocabulary("word_bpe_49k.json")
WORDS = "the river of Grün stones falls; and 3rd-party señor lies under a tide well old names".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", "\n", "x" * r.randint(0, 3)]) for _ in range(n))


TEXTS = {1: None, 2: "", 3: " \n\t", 4: prose(30, 1), 5: prose(30, 1), 6: prose(9000, 2), 7: "É" * 300, 8: "<|endoftext|> It's 12!\x1c", 9: "a" * 5000, **{i: prose(i * 37 % 900, i) for i in range(10, 90)}}
#: Columns with clashing names.
OTHERS = "rank int, score double, terms string, n int, sequence_id string, settled int, number int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2.0, "x", 3, "y", 0, 0) for i, t in [*TEXTS.items(), (5, TEXTS[5]), (None, TEXTS[20])]]
    return spark.createDataFrame(rows, f"doc_id long, text string, {OTHERS}").repartition(5)


# ---- packing


def fewest(sizes, capacity):
    """The least number of bins, by trying."""
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[k] and rooms[j] not in rooms[:j]:
                put(k + 1, [*rooms[:j], rooms[j] - sizes[k], *rooms[j + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best


def test_bounds_and_bins_against_the_optimum():
    r = random.Random(4)
    tight = 0
    for _ in range(150):
        capacity = r.choice([10, 24, 30])
        sizes = np.array([r.randint(1, capacity) for _ in range(r.randint(1, 9))])
        which, offset = certified_packing.best_fit_decreasing(sizes, capacity)
        inside = [sorted(zip(offset[which == b], sizes[which == b], strict=True)) for b in range(which.max() + 1)]
        for part in inside:
            assert [a for a, _ in part] == [0, *np.cumsum([s for _, s in part])[:-1]] and sum(s for _, s in part) <= capacity
        bound, least = certified_packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity), fewest(sizes.tolist(), capacity)
        assert -(-sizes.sum() // capacity) <= bound <= least <= len(inside)
        tight += bound == least
    assert tight > 130
    # Sizes over a half can't share: the volume alone would allow fewer.
    assert certified_packing.lower_bound(np.bincount([1100] * 10, minlength=2049)) == 10


def test_dual_feasible_functions_never_exceed_one_bin():
    values, ones = certified_packing._dual_feasible(12)
    for n in range(1, 5):
        for sizes in itertools.combinations_with_replacement(range(13), n):
            if sum(sizes) <= 12:
                assert (values[:, list(sizes)].sum(1) <= ones).all(), sizes


@pytest.mark.parametrize("lot", [1 << 16, 16])
def test_pieces(docs, lot):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    rows = certified_packing.packed(docs, WORD, lot_size=lot).collect()
    want = Counter()
    for i, t in [*TEXTS.items(), (5, TEXTS[5]), (None, TEXTS[20])]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    frame = docs.sparkSession.createDataFrame(rows)
    sequences, bound = certified_packing.certificate(frame)
    # Lots of 16 pieces hand on two at most.
    assert sequences == len(by) and bound <= sequences <= bound + (1 if lot > 16 else 3)
    assert certified_packing.packed(docs.limit(0), WORD).collect() == []


def test_exchange_closes_gaps(spark):
    """Tasks that hold but long or but short documents get worse sequences alone than together."""
    rows = [(i, "tide " * (1399 if i < 60 else 599)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id")
    alone = certified_packing._first_round(df, WORD, 2048, 1 << 16).select("sequence_id").distinct().count()
    got = certified_packing.packed(df, WORD)
    assert certified_packing.certificate(got)[0] < alone and certified_packing.certificate(got) == (60, 60)


# ---- hard negatives


def mined(rows, k=5):
    """The contract, row by row."""
    good = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e])
            good[i] = min(one, good.get(i, one))
    out = []
    for a, (label, q) in good.items():
        if a % 100:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(q, p, strict=False)), i, own) for i, (own, p) in good.items() if i != a))
        for s, p, _ in [x for x in scores if x[2] == label][:k]:
            negatives = [(n, t) for t, n, own in scores if own != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(negatives, 1)]
    return sorted(out)


def vectors(seed, n, centers=12, width=8):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centers, width))
    x = middle[r.integers(0, centers, n)] + r.normal(size=(n, width)) * 0.15
    return [(i, [float(np.float32(v)) for v in x[i]], int(r.integers(0, 10))) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, block int, kind string, q int, positives int"


@pytest.mark.parametrize("block", [8192, 90])
def test_hard_negatives(spark, block):
    rows = vectors(1, 1100)
    rows += [(2000 + i, rows[0][1], 3 + i % 2) for i in range(400)]  # copies of an anchor
    rows += [(3001, None, 1), (3002, [1.0] * 8, None), (3003, [1.0, None], 2), (3004, [float("nan")] * 8, 2), (3005, [float("inf")] * 8, 2), (3006, [], 4), (3100, [], 4), (3101, [0.5, 0.5], 4), (3200, [0.0] * 8, 5), (None, [1.0] * 8, 3), rows[7], (100, rows[3][1], 9)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(6)
    got = sorted(tuple(r) for r in hard_negatives.mined(df, block=block).collect())
    assert got == mined(rows) and len(got) > 100
    assert hard_negatives.mined(df.limit(0)).collect() == []


def test_large_components_stay_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 1]) * r.uniform(0.4, 1) * 2**20 for _ in range(8)], i % 3) for i in range(0, 300)]
    got = sorted(tuple(x) for x in hard_negatives.mined(spark.createDataFrame([(i, e, label) for i, e, label in rows], "vec_id long, embedding array<double>, label int")).collect())
    assert got == mined(rows)


def test_cover_tree_bounds_hold_and_skip():
    rows = vectors(5, 3000, centers=40, width=16)
    q = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    tree = hard_negatives.CoverTree(np.arange(3000), np.array([r[2] for r in rows]), q)
    assert sorted(tree.ids.tolist()) == list(range(3000))
    least, most = tree.node_bounds(q[:50])
    scores = q[:50] @ tree.vectors.T
    for k, leaf in enumerate(tree.leaf):
        if leaf >= 0:
            part = scores[:, tree.bounds[leaf] : tree.bounds[leaf + 1]]
            assert (part >= least[:, [k]]).all() and (part <= most[:, [k]]).all()
        for kid in tree.children[k]:
            assert tree.radius[kid] <= tree.radius[0]
    read = [tree.search(i, rows[i][2], q[i], False, [(int(scores[i].max() * 0.9), int(scores[i].max()))], 5, least[i], most[i])[1] for i in range(50)]
    assert sum(read) < 0.5 * 50 * 3000


# ---- lexical search


def ranked(texts, items, k=50):
    """The contract, row by row."""
    def terms(t):
        return lexical_search.TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    held = [(i, Counter(terms(t))) for i, t in texts]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in own.items():
        found = []
        for i, c, n in held:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // length))) for t in asked if t in c)
            if score:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "The RIVER of stones"), (2, "señor"), (3, None), (4, ""), (5, "nowhere_to be-found"), (6, prose(60, 3)), (6, "grün 3rd"), (None, "tide well"), (7, "a " * 300), (8, prose(30, 1))]


@pytest.mark.parametrize(("slice_bytes", "postings"), [(1 << 21, 1 << 20), (200, 40)])
def test_lexical_search(spark, docs, slice_bytes, postings):
    items = spark.createDataFrame([(i, t, 1.0, "x", 1) for i, t in ITEMS], "item_id long, text string, score double, doc_id string, rank int")
    texts = [*TEXTS.items(), (5, TEXTS[5]), (None, TEXTS[20])]
    got = lexical_search.ranked(docs, items, slice_bytes=slice_bytes, postings=postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(texts, ITEMS)
    assert sorted((tuple(r) for r in lexical_search.ranked(docs, items, k=3, postings=postings).collect()), key=str) == ranked(texts, ITEMS, 3)
    assert lexical_search.ranked(docs.limit(0), items).collect() == [] and lexical_search.ranked(docs, items.limit(0)).collect() == []


def test_reading_stops_before_the_ends():
    r = np.random.default_rng(2)
    n = 4000
    term = np.concatenate([np.full(n, 0), np.full(n, 1)])
    tf = r.zipf(1.6, 2 * n).clip(1, 500)
    order = np.lexsort((term, np.tile(np.arange(n), 2)))
    block = lexical_search.Block(np.arange(n), np.full(n, 100), np.arange(0, 2 * n + 1, 2), term[order], tf[order], np.array([700, 900]), n, 100 * n)
    docs, scores, read = block.best(np.array([0, 1]), 10, 0)
    full = np.array([700, 900])[term[order]] * (1_000_000_000 * tf[order] // (1000 * tf[order] + 20 * 100))
    want = sorted(zip((-full.reshape(-1, 2).sum(1)).tolist(), range(n), strict=True))[:10]
    assert sorted(zip((-scores).tolist(), docs.tolist(), strict=True))[:10] == want and read < n / 2
    assert not block.seen.any() and not block.met.any() and not block.asked.any()


def test_whole_texts_count(spark):
    long = spark.createDataFrame([(1, "x " * 400_000 + "needle"), (2, "x y")], "doc_id long, text string")
    got = lexical_search.ranked(long, spark.createDataFrame([(1, "NEEDLE")], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]
    assert certified_packing.packed(long, WORD).agg(F.sum("length")).first()[0] > 400_000
