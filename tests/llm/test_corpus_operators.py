"""Each operator against brute force on small tables that hold the awkward cases."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe_automaton, media, near_dedup, packing, quality_rules, suffix_arrays, suffix_trees, templates, textkit, toxicity, training_order
from tidewell.llm.queries import vocabulary

WORDS = re.compile("[^\x20\x09-\x0d]+")
random.seed(7)
VOCABULARY = ["".join(random.choice("aeiou") + random.choice("bcdfgé") for _ in range(random.randint(1, 4))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, every, seed):
    r = random.Random(seed)
    return " ".join(w if i % every else r.choice(VOCABULARY) + "x" for i, w in enumerate(text.split(" "), 1))


BASE, PASSAGE = prose(300, 1), prose(60, 2)
TEXTS = {
    1: None, 2: "", 3: " \n\t ", 4: "short", 5: BASE, 6: BASE, 7: edited(BASE, 60, 3), 8: edited(BASE, 12, 4), 9: prose(120, 5) + "\n" + PASSAGE + "\n" + prose(50, 6),
    10: prose(40, 7) + "  " + PASSAGE, 11: "a " * 150, 12: (prose(12, 8) + "\n") * 9, 13: prose(6000, 9), 14: "É" * 120 + "é" * 130, 15: "É" * 120 + "é" * 130 + "x", 16: "<|endoftext|> Mixed CASE, it's 12!  \n\n tail ",
    17: PASSAGE, 18: "a b c", 19: "A b C", 20: "#$% <|> ** &" * 12, 21: "　wide space \x85 x  y",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", 1, [0]) for i, t in TEXTS.items()]
    rows += [(13, TEXTS[13], "en", "s", 0, "x", 1, [0])]  # a row that is there twice
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string, key int, spans array<int>").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def windows_removed(items, n):
    """Places covered by windows that start earlier, by document."""
    seen, out = {}, {}
    for i in sorted(items):
        tokens = items[i]
        gone = [False] * len(tokens)
        for k in range(len(tokens) - n + 1):
            if seen.setdefault(tuple(tokens[k : k + n]), (i, k)) != (i, k):
                gone[k : k + n] = [True] * n
        out[i] = gone
    return out


def test_suffix_arrays(docs, empty):
    raw = {i: (t or "").encode() for i, t in TEXTS.items()}
    gone = windows_removed(raw, 100)
    got = suffix_arrays.digests(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        b, g = raw[r.doc_id], gone[r.doc_id]
        kept = bytes(c for c, x in zip(b, g, strict=True) if not x)
        runs = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(g), runs, hashlib.sha256(kept).hexdigest()), r.doc_id
    assert suffix_arrays.digests(empty).collect() == []


def test_suffix_arrays_cut_texts(docs, empty):
    got = {r.doc_id: r for r in suffix_arrays.without_repeats(docs).collect()}
    assert suffix_arrays.without_repeats(docs).columns == docs.columns and got[6].text == "" and got[5].text == BASE and got[6].n_chars == 0
    assert PASSAGE not in got[10].text and PASSAGE in got[9].text and got[1].text is None and got[15].text in ("x", "Éx", "éx")
    assert suffix_arrays.without_repeats(empty).count() == 0


def test_suffix_trees(docs, empty):
    words = {i: WORDS.findall(t or "") for i, t in TEXTS.items()}
    gone = windows_removed(words, 20)
    for r in suffix_trees.digests(docs).collect():
        kept = " ".join(w for w, x in zip(words[r.doc_id], gone[r.doc_id], strict=True) if not x)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words[r.doc_id]), sum(gone[r.doc_id]), hashlib.sha256(kept.encode()).hexdigest()), r.doc_id
    assert suffix_trees.digests(empty).collect() == []


def test_hot_passage_and_many_copies(spark):
    rows = [(i, f"{prose(30, i)} {PASSAGE} {prose(30, 1000 + i)}") for i in range(300)] + [(1000 + i, BASE) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    raw = {i: t.encode() for i, t in rows}
    gone = windows_removed(raw, 100)
    assert {r.doc_id: r.n_removed for r in suffix_arrays.digests(df).collect()} == {i: sum(g) for i, g in gone.items()}


def components_of(n, percent, texts=None):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in (texts or TEXTS).items():
        w = WORDS.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_dedup(docs, empty):
    want = components_of(4, 80)
    got = near_dedup.near_groups(docs, 4, 80).collect()
    assert len(got) == len(TEXTS) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert near_dedup.near_groups(empty, 4, 80).collect() == []
    assert {r.doc_id for r in near_dedup.keep_one(docs).collect()} == {i for i, x in components_of(5, 80).items() if x[2]}


def test_near_copies_without_a_central_text(spark):
    texts = {i: edited(BASE, 25 + i % 60, i) for i in range(120)} | {1000 + i: prose(80, i) for i in range(100)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df, 4, 80).collect()} == components_of(4, 80, texts)


@pytest.mark.parametrize("stray", ["m1", "m2"])
def test_a_mixed_bucket_opens_all_its_slices(spark, stray):
    import pyarrow as pa

    # Slices H; T2, m2; m1. H comes first in every order of hubs, and T2 before m2.
    kinds = np.arange(near_dedup.HUBS)
    rank = lambda i: near_dedup._hub_rank(np.full(len(kinds), i), kinds)
    h = next(i for i in range(1, 10**6) if (rank(i) < 1 << 60).all())
    after = [i for i in range(h + 1, h + 2000) if (rank(i) > rank(h)).all()]
    t2, m2 = next((x, y) for x in after for y in after if (rank(x) < rank(y)).all())
    m1 = next(i for i in after if i not in (t2, m2))
    sig = np.arange(near_dedup.HASHES, dtype=np.uint32).tobytes()
    slices = [pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([sig] * len(ids), pa.binary())], names=["doc_id", "sig"]) for ids in ([h], [t2, m2], [m1])]
    rows = pa.Table.from_batches(near_dedup._all_buckets(near_dedup._own_buckets(iter(slices)))).to_pylist()
    assert {(r["a"], r["b"]) for r in rows} == {(m2, t2), (t2, h), (m1, h)}
    stars = spark.createDataFrame([(r["a"], r["b"], r["wide"]) for r in rows], "a long, b long, wide int")
    label = spark.createDataFrame([(i, h) for i in (h, t2, m1, m2) if i != {"m1": m1, "m2": m2}[stray]], "node long, component long")
    assert {r.doc_id for r in near_dedup.opened(stars, label).collect()} == {h, t2, m1, m2}


def test_near_dedup_over_many_slices(spark):
    texts = {i: edited(BASE, 25 + i % 60, i) for i in range(120)} | {1000 + i: edited(edited(BASE, 25, i), 9 + i % 9, 500 + i) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = near_dedup.near_groups(df, 4, 80).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == components_of(4, 80, texts)


def test_quality_rules(docs, empty):
    ledger = quality_rules.ledger(docs).cache()
    for r in ledger.collect():
        t = TEXTS[r.doc_id] or ""
        w = WORDS.findall(t)
        runs = {}
        for k in range(len(w) - 7):
            runs.setdefault(tuple(w[k : k + 8]), []).append(k)
        again = {p for at in runs.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)), r.doc_id
    verdict = by_id(quality_rules.apply_policy(ledger))
    assert verdict[5].kept and verdict[13].kept and not verdict[1].kept and verdict[11].base_failed and not verdict[20].kept
    ablated = {r.rule: r for r in quality_rules.ablation(ledger, "v2").collect()}
    bits = [r.failed & quality_rules.mask("v2") for r in ledger.collect()]
    for rule, bit in quality_rules.BITS.items():
        assert (ablated[rule].n_failed, ablated[rule].n_failed_alone) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))
    assert quality_rules.ledger(empty).collect() == []
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_no_text_is_too_long_for_the_pipeline(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, prose(1_000_001, 3)), (2, "short")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.quality(spark, docs, "").select("doc_id").collect()] == [1]
    failed = {r.doc_id: r.failed for r in quality_rules.ledger(docs).collect()}
    assert failed[1] == quality_rules.BITS["many_words"]


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_bpe_automaton(docs, empty):
    t = tokenizer("word_bpe_49k.json")
    for r in bpe_automaton.coded(docs, vocabulary("word_bpe_49k.json")).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), r.doc_id
    assert bpe_automaton.coded(empty, vocabulary("word_bpe_49k.json")).collect() == []


def test_automaton_accepts_what_merging_gives():
    t, own = tokenizer("word_bpe_49k.json"), bpe_automaton.WordEncoder(vocabulary("word_bpe_49k.json"))
    r = random.Random(3)
    words = ["".join(r.choice("aaabbcdeeinostth'!.12ÉéßΣ日🙂́") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    words += ["a" * 1000, "ab" * 3000 + "!!!" * 500, "x" * 257, "y" * 256, "<|endoftext|>x<|startoftext|>", "A\xa0B", "\x85"]
    for word, ids in zip(words, own.encode(words), strict=True):
        assert ids == t.encode(word, add_special_tokens=False).ids, word


def test_packing(docs, empty):
    t = tokenizer("byte_bpe_50k.json")
    pieces = packing.packed(docs, vocabulary("byte_bpe_50k.json")).collect()
    whole = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in TEXTS.items()}
    counts = {i: 2 if i == 13 else 1 for i in TEXTS}
    for i, ids in whole.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert sum(p.length for p in own) == counts[i] * len(ids) and all(p.doc_tokens == len(ids) for p in own)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and sum(p.length for p in own) <= 1024 and len(own) <= 64
    assert packing.packed(empty, vocabulary("byte_bpe_50k.json")).collect() == []


def test_packing_keeps_all_limits():
    sizes = np.array([random.Random(i).randint(1, 900) for i in range(400)])
    loss = lambda item, at, length: length if item % 2 else length // 3
    seen = {}
    for inside in packing.pack(sizes, loss, (1024, 6, 700)):
        assert sum(p[2] for p in inside) <= 1024 and len(inside) <= 6 and sum(loss(*p) for p in inside) <= 700
        for item, at, length in inside:
            seen.setdefault(item, []).append((at, length))
    for item, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[item]):
            assert start == at
            at += length
        assert at == size


def test_training_order(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    table = docs.cache()
    manifest = training_order.written(table, path, length=64)
    rows = sorted(training_order.sequences(manifest, 64).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) and len({r.sequence for r in rows}) == len(rows)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    t = tokenizer("byte_bpe_50k.json")
    assert sum(r.n_tokens for r in rows) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert {r.slot for r in training_order.sequences(manifest, 64, 50).collect()} == set(range(50, len(rows)))
    assert training_order.written(empty, path).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_permutes(size):
    assert sorted(training_order.permuted(np.arange(size), size).tolist()) == list(range(size))


def test_media(docs, empty, spark):
    for r in media.stored(docs).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        assert r.error is None and r.n_bytes == len(raw) and bytes(r.payload) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0") and media.to_image(raw) == bytes(r.media)
    assert media.stored(empty).collect() == []


def test_media_members_fail_alone(docs, spark):
    from pyarrow import fs

    from tidewell.llm.common import new_folder

    folder = new_folder(spark, "media")
    (row, *_) = media.write_archives(docs.coalesce(1), folder).collect()
    store, path = fs.FileSystem.from_uri(row.archive)
    raw = bytearray(store.open_input_file(path).read())
    first = raw.index(b"PK\3\4", 10)
    raw[first] = 0
    with store.open_output_stream(path) as f:
        f.write(bytes(raw))
    got = media.decoded(media.read_archives(spark, [(row.archive, row.bytes)], 2000)).collect()
    assert len(got) == len(TEXTS) + 1 and sum(r.error is not None for r in got) == 1


def test_toxicity(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = prose(r.randint(30, 200), i).split()
        if toxic:
            w = [r.choice(["zorgh", "vrekk", "vrekkon", "vrekkade"]) if r.random() < 0.06 else x for x in w] + ["zorgh"]
        rows.append((i, " ".join(w), "en"))
        if i % 3:
            continue
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "en"), (5001, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([*labels, (7, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.scored(docs, marks))
    assert len(got) == 1202 and got[5000].score == 0 == got[5001].score
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(i % 6 == 0, x.predicted) for i, x in got.items() if x.held_out and i < 5000]
    assert sum(a and b for a, b in held) / sum(a for a, _ in held) > 0.9 and sum(b and not a for a, b in held) / len(held) < 0.03
    assert toxicity.scored(docs.limit(0), marks).collect() == []
    assert all(r.score < 0.3 for r in toxicity.scored(docs, marks.limit(0)).collect())


def test_toxicity_model_is_whole(spark):
    import pyarrow as pa

    # More entries than 2 ** 20: words of their own 6-grams, each seen once.
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[i // 26**k % 26] for k in range(5))
    rows = [(d, " ".join(word(d * 4000 + i) for i in range(4000)), int(d % 2)) for d in range(120)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit_model(labelled)
    scorer = toxicity.written(model)
    entries = spark.read.parquet(scorer.folder)
    held = entries.count()
    assert held > 1 << 20 and model.count() == held
    few = toxicity.Scorer(scorer.folder, scorer.files, kept=1000)
    data, offs = textkit.text_bytes(pa.array([t for _, t, _ in rows[:6]]))
    a, b = scorer.evidence(data, offs), few.evidence(data, offs)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert all((a[0][d] > 0) == (d % 2 == 1) for d in range(6))


def test_toxicity_counts_all_but_the_calibration_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 10)
    seen = []
    fit = toxicity.fit_model
    monkeypatch.setattr(toxicity, "fit_model", lambda rows: seen.append({r.doc_id for r in rows.select("doc_id").collect()}) or fit(rows))
    docs = spark.createDataFrame([(i, prose(20, i)) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 3 == 0) for i in range(400)], "doc_id long, toxic boolean")
    toxicity.scored(docs, marks)
    of_fold = {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 3}
    assert 0 < len(of_fold - seen[0]) <= 30 and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in seen[0])


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a = "</p>";</script></head><body class="home"><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">A{i}</a><li><a href="/b">B</a></ul></nav><div class="ad">Buy {i}</div><article><h1>Head &amp; {i}</h1><p>First  {i}<br>line<p><b>Sec&eacute;nd</b> &#65;</p>
<div class="comments"><p>no {i}</p></div><form>x</form><aside>side</aside></article><div class="comments"><p>reader {i}</p></div><footer>&copy; f</footer>"""


def test_templates(spark):
    rows = [(i, f"https://h{i % 2}.example/p/{i}", PAGE.format(i=i), "x") for i in range(12)]
    rows += [(100, None, None, "x"), (101, "http://one.example/", "", "x"), (102, "http://plain.example/", "<p>only &lt;text&gt;", "x"), (103, "x", "<div class='ad'>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in templates.extracted(pages).collect()}
    for i in range(12):
        assert got[i].text == f"Head & {i}\nFirst {i} line\nSecénd A" and got[i].n_chars == len(got[i].text), got[i].text
    assert got[100].text == got[101].text == got[103].text == "" and got[102].text == "only <text>"
    assert templates.extracted(pages.limit(0)).collect() == []


def plain_host(n):
    """A host without telling names: a long notice, whose place comes first, and a text."""
    notice = prose(60, 77)
    page = "<html><body><div><div>{notice}</div></div><div><h1>{title}</h1><p>{one}<p>{two}</div><div><div>Written for you by us</div></div></body></html>"
    rows, want = [], {}
    for i in range(n):
        title, one, two = prose(4, 500 + i), prose(8 + i % 5, 600 + i), prose(9, 700 + i)
        rows.append((i, f"http://plain.example/{i}", page.format(notice=notice, title=title, one=one, two=two)))
        want[i] = f"{title}\n{one}\n{two}"
    return rows, want


def test_the_template_decides_where_names_dont(spark):
    rows, want = plain_host(8)
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want
    assert all(templates.main_text(html) != want[i] for i, _, html in rows)


def test_equivalence_classes_against_brute_force(spark):
    rows, _ = plain_host(7)
    rows += [(100 + i, "http://plain.example/x", f"<html><body><section><p>{prose(5, i)}" + "<p>again" * (i % 3)) for i in range(5)]
    pages = spark.createDataFrame([("h", i, html) for i, _, html in rows], "host string, page long, html string")
    blocks = templates.page_blocks(pages).cache()
    vectors, places = {}, {}
    for i, _, html in rows:
        for path, _, _, pos in templates.runs(html):
            vectors.setdefault(path, {}).setdefault(i, []).append(pos)
    for path, at in vectors.items():
        places.setdefault(tuple(sorted((i, len(x)) for i, x in at.items())), set()).add(path)
    classes = templates.equivalence_classes(blocks)
    got = {}
    for r in classes.collect():
        got.setdefault(r["class"], set()).add(r.place)
        assert (r.pages, r.n) == (len(vectors[r.place]), sum(map(len, vectors[r.place].values()))) and r.size == len(places[tuple(sorted((i, len(x)) for i, x in vectors[r.place].items()))])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, places.values()))
    valid = []
    for vector, own in places.items():
        if len(vector) >= 2 and all(n == 1 for _, n in vector):
            orders = {tuple(sorted(own, key=lambda p: vectors[p][i][0])) for i, _ in vector}
            if len(orders) == 1:
                valid.append((len(vector), len(own), own))
    frame = {r.place for r in templates.frames(blocks, classes).collect()}
    assert frame in [own for pages, size, own in valid if (pages, size) == max((p, s) for p, s, _ in valid)]


SHAPES = {
    "side word on body": ("<body class='right-sidebar'><div class='left-menu'>m</div><article><p>{t}</article>", "{t}"),
    "side word on html": ("<html class='menu-closed'><body><main><p>{t}</main>", "{t}"),
    "comments by id": ("<body><article><p>{t}<section id='comments'><p>reader says</section></article>", "{t}"),
    "camel case": ("<body><article><p>{t}<div class='relatedPosts'><p>more</div></article><div class='cookieBanner'>we use</div>", "{t}"),
    "sidebar by id": ("<body><div id='sidebar'>links and more links here</div><div id='page'><h1>T</h1><p>{t}</div>", "T\n{t}"),
    "no sidebar": ("<body><div class='no-sidebar'><p>{t}</div>", "{t}"),
    "names with digits": ("<body><div class='c1'>{t}</div><div class='c2'>{t} more</div>", "{t}\n{t} more"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_page_shapes(shape):
    page, want = SHAPES[shape]
    t = prose(12, 3)
    assert templates.main_text(page.format(t=t)) == want.format(t=t)
    places = [path for path, *_ in templates.runs("<div class='c1'>a</div><div class='c2'>b</div><div class='post-12345'>c</div><div class='post-99999'>d</div>")]
    assert len(set(places)) == 3


def test_templates_of_hosts_with_several_layouts(spark):
    side = "<nav><a href='/'>home</a></nav><div class=tools>Print this page</div>"
    bodies = {
        "article": lambda i: (f"<article><p>{prose(40, i)}</article>", prose(40, i)),
        "plain": lambda i: (f"<div class=x><p>{prose(30, i)}</div>", prose(30, i)),
        "lighter": lambda i: (f"<section class=y><p>{prose(12, i)}</section>", prose(12, i)),
        "wrapped": lambda i: (f"<div class=no-sidebar><div class=menu><main><p>{prose(12, i)}</main></div></div>", prose(12, i)),
    }
    rows, want = [], {}
    for host, layouts in (("a", ["article"] * 30 + ["plain"]), ("b", ["plain"] * 6 + ["lighter"] * 3), ("c", ["wrapped"] * 3 + ["plain"] * 3)):
        for layout in layouts:
            i = len(rows)
            text, want[i] = bodies[layout](i)
            rows.append((i, f"http://{host}.example/{i}", f"<body class='no-sidebar header'>{side}{text}<div class=comments><div class=body>reader {i}</div></div>"))
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_word_tables_follow_the_definition():
    import pyarrow as pa

    data, offs = textkit.text_bytes(pa.array([t for t in TEXTS.values()], pa.string()))
    words = textkit.Words(data, offs)
    raw = data.tobytes()
    for row, t in enumerate(TEXTS.values()):
        span = slice(words.first[row], words.first[row + 1])
        assert [raw[a:b].decode() for a, b in zip(words.start[span], words.end[span], strict=True)] == WORDS.findall(t or "")
    assert html.unescape("&am") == "&am"


def test_classes_nest_into_slots(spark):
    """One place has a notice before the inner class's member and the text behind it: only the nested class tells them apart, as the frame stands around both."""
    rows, want = [], {}
    for i in range(12):
        n = 3 + i % 3
        head, foot = prose(3, 900 + i), prose(3, 950 + i)
        if i < 8:
            notes = "".join(f"<p><a href='/x'>{prose(7, 1000 + 10 * i + k)}</a></p>" for k in range(n))
            text = [prose(9, 2000 + 10 * i + k) for k in range(2)]
            inner = f"{notes}<h4>{prose(3, 40 + i)}</h4>" + "".join(f"<p>{x}</p>" for x in text)
        else:
            inner = f"<p>{prose(9, 3000 + i)}</p>"
        rows.append((i, "http://nest.example/", f"<body><h5>{head}</h5><div>{inner}</div><h6>{foot}</h6>"))
    pages = spark.createDataFrame([("h", i, page) for i, _, page in rows], "host string, page long, html string")
    blocks = templates.page_blocks(pages).cache()
    classes = templates.equivalence_classes(blocks)
    cuts, behind = templates.nested(blocks, classes)
    cuts = [r.asDict() for r in cuts.collect()]
    assert {c["place"].split("/")[-1] for c in cuts if c["slot"] == templates.PAGE} == {"h5", "h6"}
    (inner,) = [c for c in cuts if c["place"].endswith("/h4")]
    template = templates.Template(cuts)
    slots = {(r.page, r.pos): r.slot for r in behind.collect()}
    for i, _, page in rows:
        found = [(path, pos) for path, _, _, pos in templates.runs(page) if templates._role(path) >= 0]
        got = template.slots([path for path, _ in found])
        assert got[-1] != got[0] and all(slots.get((i, pos), slot) == slot for (_, pos), slot in zip(found, got, strict=True))
        if i < 8:
            at = next(k for k, (path, _) in enumerate(found) if path.endswith("/h4"))
            assert inner["slot"] != templates.PAGE and not set(got[1:at]) & set(got[at + 1 : -1])


def test_templates_come_from_distinct_layouts(spark, monkeypatch):
    """Nesting wrote every page's runs once a round (op1, 2.5 x input): pages of one layout count, but go through it once."""
    rows, want = plain_host(40)
    rows = [(i, url, html + "<p>last" * (i % 2)) for i, url, html in rows] + [(7, "http://plain.example/7", rows[7][2] + "<p>last")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    hosted = spark.createDataFrame([("h", i, html) for i, (_, _, html) in enumerate(rows)], "host string, page long, html string")
    laid = templates.layouts(templates.page_rows(hosted))
    assert sorted(r.copies for r in laid.collect()) == [20, 22]
    classes = [templates.equivalence_classes(blocks) for blocks in (templates.places(laid), templates.page_blocks(hosted))]
    one, other = (sorted((r.place, r.pages, r.n, r.size, round(r["at"], 9)) for r in x.collect()) for x in classes)
    assert one == other and len(one) == 4
    alike = lambda x: {frozenset(r.place for r in x if r["class"] == c) for c in {r["class"] for r in x}}
    assert alike(classes[0].collect()) == alike(classes[1].collect())
    sizes, write = [], templates.materialized

    def counted(df, purpose):
        out = write(df, purpose)
        sizes.append((purpose, out.count()))
        return out

    monkeypatch.setattr(templates, "materialized", counted)
    got = templates.extracted(pages).collect()
    assert len(got) == 42 and all(r.text.startswith(want[r.page_id]) for r in got)
    assert max(n for purpose, n in sizes if purpose != "template-pages") < len(rows)


def test_texts_of_parts_count_pages_once():
    import pyarrow as pa

    lists = {"parts": [[1, 1, 2, 1], [1, 2], [], [2, 1]], "of": [[4, 4, 9, 4], [4, 9], [], [9, 4]], "texts": [[5, 5, 5, 6], [5, 5], [], [6, 5]], "words": [[3, 3, 3, 1], [3, 3], [], [1, 3]], "linked": [[1, 0, 0, 1], [0, 0], [], [1, 0]]}
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in lists.values()], names=list(lists))
    (got,) = templates._part_texts(iter([batch]))
    assert [tuple(r.values()) for r in got.to_pylist()] == [(1, 5, 4, 3, 4, 12, 1), (1, 6, 4, 1, 1, 1, 1), (2, 5, 9, 2, 2, 6, 0), (2, 6, 9, 1, 1, 1, 1)]
    assert sum(r["n"] for b in templates._part_texts(iter([batch.slice(1)])) for r in b.to_pylist()) == 4
